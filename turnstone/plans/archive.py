"""Queries over conversation trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import archive as a
from .tables import TREE_SQL, TURNS_SQL, tree, turns


@query("conversation_summaries", f"""
    WITH {TREE_SQL}, leaf AS (SELECT * FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = t.id)),
    l AS (SELECT conversation_id, string_agg(id, ',' ORDER BY timestamp_ns DESC, id) AS leaves FROM leaf GROUP BY conversation_id)
    SELECT conversation_id, count(*) AS turns, max(timestamp_ns) AS latest_ns, any_value(leaves) AS leaves
    FROM tree JOIN l USING (conversation_id) GROUP BY conversation_id""")
def conversation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.conversation_summaries(tree(spark, sf_dir)).withColumn("leaves", F.array_join("leaves", ","))


_PATHS_SQL = f"""WITH RECURSIVE {TREE_SQL}, leaf AS (
        SELECT conversation_id, id FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = t.id)
    ), path(conversation_id, leaf, id, back) AS (
        SELECT conversation_id, id, id, 0 FROM leaf
        UNION ALL SELECT p.conversation_id, p.leaf, t.parent_id, p.back + 1
        FROM path p JOIN tree t ON t.id = p.id WHERE t.parent_id IS NOT NULL
    )"""


def _paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = tree(spark, sf_dir)
    return nodes, a.paths(nodes, a.leaves(nodes).select("conversation_id", F.col("id").alias("leaf")))


@query("branch_path", f"""{_PATHS_SQL}
    SELECT conversation_id, leaf, id, max(back) OVER (PARTITION BY leaf) - back AS position FROM path""")
def branch_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of every branch from root to leaf."""
    _, p = _paths(spark, sf_dir)
    length = p.groupBy("conversation_id", "leaf").agg(F.max("back").alias("last"))
    return p.join(length, ["conversation_id", "leaf"]).select("conversation_id", "leaf", "id", (F.col("last") - F.col("back")).alias("position"))


@query("branch_transcript", f"""{_PATHS_SQL}
    SELECT p.leaf, string_agg(t.role || ': ' || t.content, chr(10) ORDER BY p.back DESC) AS transcript, count(*) AS turns
    FROM path p JOIN tree t ON t.id = p.id GROUP BY p.leaf""")
def branch_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, p = _paths(spark, sf_dir)
    rows = p.join(nodes.select("conversation_id", "id", "role", "content"), ["conversation_id", "id"])
    lines = F.collect_list(F.struct((-F.col("back")).alias("o"), F.concat("role", F.lit(": "), "content").alias("line")))
    return rows.groupBy("leaf").agg(F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n").alias("transcript"), F.count("*").alias("turns"))


@query("turn_page", f"""{_PATHS_SQL}
    SELECT p.leaf, p.id, 2 - p.back AS position, o.id AS older
    FROM path p LEFT JOIN path o ON o.leaf = p.leaf AND o.back = 3 WHERE p.back < 3""")
def turn_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of every branch, and the cursor of the page before."""
    _, p = _paths(spark, sf_dir)
    older = p.where("back = 3").select("conversation_id", "leaf", F.col("id").alias("older"))
    page = p.where("back < 3").join(older, ["conversation_id", "leaf"], "left")
    return page.select("leaf", "id", (2 - F.col("back")).alias("position"), "older")


@query("branch_points", f"""
    WITH {TREE_SQL}, c AS (SELECT parent_id, count(*) AS children FROM tree WHERE parent_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    SELECT t.conversation_id, t.id, t.parent_id, c.children FROM tree t JOIN c USING (parent_id)""")
def branch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.branch_points(tree(spark, sf_dir)).select("conversation_id", "id", "parent_id", "children")


@query("node_depths", f"""WITH RECURSIVE {TREE_SQL}, d(conversation_id, id, depth, root) AS (
        SELECT conversation_id, id, 0, id FROM tree WHERE parent_id IS NULL
        UNION ALL SELECT t.conversation_id, t.id, d.depth + 1, d.root FROM tree t JOIN d ON t.parent_id = d.id)
    SELECT conversation_id, id, depth, root FROM d""")
def node_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.depths(tree(spark, sf_dir))


_RANGES_SQL = f"""WITH {TURNS_SQL}, n AS (SELECT conversation_id, CAST(count(*) AS BIGINT) AS length FROM turns GROUP BY 1),
    w AS (SELECT conversation_id, length, unnest(range(0, length - 3, 2)) AS start FROM n WHERE length >= 4),
    r AS (SELECT conversation_id, start, start + 4 AS "end" FROM w
          UNION SELECT conversation_id, greatest(0, length - 4), length FROM n)"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = turns(spark, sf_dir).groupBy("conversation_id").agg(F.count("*").alias("length"))
    return a.windows(length, ["conversation_id"], size=4, overlap=2)


@query("fragment_windows", f'{_RANGES_SQL} SELECT conversation_id, start, "end" FROM r')
def fragment_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four turns, two apart, with the closing tail."""
    return _ranges(spark, sf_dir)


@query("fragment_text", f"""{_RANGES_SQL}
    SELECT r.conversation_id, start, "end", string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS text
    FROM r JOIN turns t ON t.conversation_id = r.conversation_id AND turn >= start AND turn < "end" GROUP BY ALL""")
def fragment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumnRenamed("turn", "position")
    return a.range_text(rows, _ranges(spark, sf_dir), ["conversation_id"])


_CYCLES_SQL = f"""WITH {TURNS_SQL}, c AS (
        SELECT *, greatest(0, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conversation_id ORDER BY turn) - 1) AS cycle FROM turns)"""


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    c = t.withColumn("cycle", a.cycles(t, ["conversation_id"], "turn"))
    return c.groupBy("conversation_id", "cycle").agg(F.min("turn").alias("start"), (F.max("turn") + 1).alias("end"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@query("response_cycles", f"""{_CYCLES_SQL}
    SELECT conversation_id, cycle, min(turn) AS start, max(turn) + 1 AS "end", CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM c GROUP BY 1, 2""")
def response_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycles(spark, sf_dir)


@query("episode_pack", f"""{_CYCLES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, g AS (
        SELECT conversation_id, cycle, min(turn) AS start, max(turn) + 1 AS "end", CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM c GROUP BY 1, 2
    ), p(conversation_id, cycle, episode, bytes, s, e) AS (
        SELECT conversation_id, cycle, 0, bytes, start, "end" FROM g WHERE cycle = 0
        UNION ALL SELECT g.conversation_id, g.cycle, CASE WHEN p.bytes + g.bytes <= 1000 THEN p.episode ELSE p.episode + 1 END,
                  CASE WHEN p.bytes + g.bytes <= 1000 THEN p.bytes + g.bytes ELSE g.bytes END, g.start, g."end"
        FROM p JOIN g ON g.conversation_id = p.conversation_id AND g.cycle = p.cycle + 1)
    SELECT conversation_id, episode, min(s) AS start, max(e) AS "end", max(bytes) AS bytes FROM p GROUP BY 1, 2""")
def episode_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles packed into episodes of at most 1000 bytes."""
    return a.packed_episodes(_cycles(spark, sf_dir), "conversation_id", 1000)


@query("bounded_evidence", f"""WITH RECURSIVE {TURNS_SQL}, t AS (SELECT conversation_id, id, CAST(octet_length(encode(content)) AS BIGINT) AS bytes, CAST(-octet_length(encode(content)) * 10 + turn AS BIGINT) AS rank FROM turns),
    n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY rank) AS k FROM t),
    p(conversation_id, k, turns, used, taken) AS (SELECT DISTINCT conversation_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), false FROM n
        UNION ALL SELECT n.conversation_id, n.k, p.turns + CAST(p.turns < 3 AND p.used + n.bytes <= 700 AS INT), CASE WHEN p.turns < 3 AND p.used + n.bytes <= 700 THEN p.used + n.bytes ELSE p.used END, p.turns < 3 AND p.used + n.bytes <= 700
        FROM p JOIN n ON n.conversation_id = p.conversation_id AND n.k = p.k + 1)
    SELECT n.conversation_id, n.id, n.bytes, n.rank FROM n JOIN p USING (conversation_id, k) WHERE taken""")
def bounded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 3 turns and 700 bytes a conversation, longest first, skipping what doesn't fit."""
    t = turns(spark, sf_dir).select("conversation_id", "id", F.octet_length("content").cast("long").alias("bytes"), (-F.octet_length("content") * 10 + F.col("turn")).cast("long").alias("rank"))
    return a.bounded_evidence(t, "conversation_id", 3, 700)


@query("coverage_gaps", f"""{_RANGES_SQL}, k AS (SELECT * FROM r WHERE start <> 2),
    e AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY conversation_id ORDER BY start, "end"), 0) AS expected FROM k)
    SELECT conversation_id, start, "end", expected FROM e WHERE start <> expected""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the fragments, without those that begin at turn 2, don't follow each other."""
    return a.coverage_gaps(_ranges(spark, sf_dir).where("start <> 2"), ["conversation_id"]).select("conversation_id", "start", "end", "expected")


@query("archive_stats", f"""
    WITH {TREE_SQL} SELECT count(*) AS nodes, count(DISTINCT conversation_id) AS conversations,
           count(DISTINCT sha256(content)) AS contents, count(*) FILTER (WHERE parent_id IS NULL) AS roots,
           CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM tree""")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return t.agg(F.count("*").alias("nodes"), F.count_distinct("conversation_id").alias("conversations"), F.count_distinct(F.sha2("content", 256)).alias("contents"), F.count_if(F.col("parent_id").isNull()).alias("roots"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@query("integrity_report", f"""
    WITH {TREE_SQL}, gone AS (SELECT * FROM tree WHERE turn <> 1),
    parents AS (SELECT id FROM gone g WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gone p WHERE p.id = g.parent_id)),
    labelled AS (SELECT doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)),
    customers AS (SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey))
    SELECT 'missing parent' AS "check", id AS key FROM parents
    UNION ALL SELECT 'label without document', CAST(doc_id AS VARCHAR) FROM labelled
    UNION ALL SELECT 'order without customer', CAST(o_orderkey AS VARCHAR) FROM customers""")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a target; turns number 1 are taken away to have some."""
    gone = tree(spark, sf_dir).where("turn <> 1")
    have = gone.select("conversation_id", F.col("id").alias("parent_id"))
    get = lambda name: table(spark, sf_dir, name)
    return a.violations({
        "missing parent": gone.where("parent_id is not null").join(have, ["conversation_id", "parent_id"], "left_anti").select("id"),
        "label without document": get("labels").join(get("documents"), "doc_id", "left_anti").select("doc_id"),
        "order without customer": get("orders").join(get("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey"),
    })
