"""Queries over files that they write first: imports of conversation trees, as a batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import archive as a
from ..operators.importing import imported
from ..session import scratch
from ..sources import graphlines
from .streams import _run
from .tables import TREE_SQL, tree


def _lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the conversations as tagged lines: each node, some of them twice, a branch for each leaf,
    and a bad line for each conversation."""
    t = tree(spark, sf_dir)
    text = lambda kind, *cols: F.to_json(F.struct(F.lit(kind).alias("kind"), *cols)).alias("value")
    conv = F.col("conversation_id").cast("string").alias("conversation_id")
    nodes = t.select(text("node", "id", conv, "parent_id", "role", "timestamp_ns", "content"))
    again = t.where("turn % 4 = 1").select(text("node", "id", conv, "parent_id", "role", "timestamp_ns", "content"))
    ends = a.leaves(t).select(text("branch", F.concat(F.lit("b-"), "id").alias("id"), conv, F.col("id").alias("leaf_node_id"), (F.col("turn") % 2 == 0).alias("canonical")))
    heads = t.where("turn = 0")
    k = F.col("conversation_id") % 3
    bad = heads.select(F.when(k == 0, F.concat(F.lit("no json "), "conversation_id")).when(k == 1, text("ghost", conv)).otherwise(text("node", "id", conv, "role")).alias("value"))
    folder = f"{scratch(spark)}/lines-{uuid.uuid4().hex}"
    nodes.union(again).union(ends).union(bad).repartition(3, F.xxhash64("value")).write.text(folder)
    graphlines.register(spark)
    return folder


_LEAVES_SQL = f"""{TREE_SQL}, l AS (SELECT conversation_id, id FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = t.id)),
    up(leaf, id, back) AS (SELECT id, id, 0 FROM l UNION ALL SELECT u.leaf, t.parent_id, u.back + 1 FROM up u JOIN tree t ON t.id = u.id WHERE t.parent_id IS NOT NULL),
    n AS (SELECT leaf, max(back) + 1 AS length FROM up GROUP BY leaf),
    p AS (SELECT up.leaf, up.id, length, length - 1 - back AS position FROM up JOIN n USING (leaf)),
    r0 AS (SELECT leaf, length, unnest(range(0, greatest(length - 2, 0), 2)) AS start FROM n WHERE length >= 3),
    r AS (SELECT leaf, start, start + 3 AS "end" FROM r0 UNION SELECT leaf, greatest(length - 3, 0), length FROM n WHERE length < 3 OR (length - 3) % 2 <> 0)"""


@query("graph_import", f"""WITH RECURSIVE {_LEAVES_SQL}
    SELECT CAST(t.conversation_id AS VARCHAR) AS conversation_id, 'b-' || r.leaf AS branch, start, "end", string_agg(role || ': ' || content, chr(10) ORDER BY position) AS text
    FROM r JOIN p ON p.leaf = r.leaf AND position >= start AND position < "end" JOIN tree t ON t.id = p.id GROUP BY ALL""")
def graph_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of three turns, two apart, of every branch of the files, read in splits of 4 KB."""
    rows = spark.read.format("graphlines").option("splitBytes", "4096").load(_lines(spark, sf_dir))
    return imported(rows, turns=3, overlap=1)["fragments"]


@query("graph_lines", f"""WITH RECURSIVE {TREE_SQL}
    SELECT 'node' AS kind, id, NULL AS problem, content, CAST(1 + CAST(turn % 4 = 1 AS INT) AS BIGINT) AS n FROM tree
    UNION ALL SELECT 'branch', 'b-' || id, NULL, NULL, 1 FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = t.id)
    UNION ALL SELECT 'rejected', NULL, CASE conversation_id % 3 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'unknown kind' ELSE 'lacks timestamp_ns' END,
        CASE conversation_id % 3 WHEN 0 THEN 'no json ' || conversation_id WHEN 1 THEN '{{"kind":"ghost","conversation_id":"' || conversation_id || '"}}'
        ELSE '{{"kind":"node","id":"' || id || '","conversation_id":"' || conversation_id || '","role":"' || role || '"}}' END, 1 FROM tree WHERE turn = 0""")
def graph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream: every line once, bad ones with the reason."""
    stream = spark.readStream.format("graphlines").load(_lines(spark, sf_dir))
    return _run(stream).groupBy("kind", "id", "problem", "content").agg(F.count("*").alias("n"))
