"""Queries of upkeep: relations of parts and suppliers, labels of vectors as communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import graph as g
from ..operators import maintenance as m
from .graph import _LOG_SQL, _S, _log, _steps
from .vectors import _COS, _vectors


@query("memory_projection", f"""WITH {_LOG_SQL}, b AS (SELECT * FROM log WHERE kind <> 2), n AS (SELECT source AS node FROM b UNION SELECT target FROM b)
    SELECT 'nodes' AS part, count(*) AS n, min(node) AS least, max(node) AS most FROM n UNION ALL SELECT 'relations', count(*), min(source), max(target) FROM rel WHERE kind <> 2""")
def memory_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of kinds 0 and 1, kind 2 standing for associations with entities."""
    log = _log(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == 2, m.ENTITY_ASSOCIATION).otherwise(F.col("kind")))
    relations, nodes = m.memory_projection(log)
    one = lambda df, name, a, b: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.min(a).alias("least"), F.max(b).alias("most"))
    return one(nodes, "nodes", "node", "node").union(one(relations, "relations", "source", "target"))


_EDITS_SQL = f"""ed AS (SELECT DISTINCT l_partkey AS source, l_suppkey + {_S} AS target, CAST(l_partkey % 3 AS INTEGER) AS old_kind, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 4 AS INTEGER) END AS new_kind FROM lineitem WHERE l_linenumber = 2)"""


@query("relation_edits", f"""WITH {_LOG_SQL}, {_EDITS_SQL}, x AS (SELECT * FROM ed WHERE old_kind IS DISTINCT FROM new_kind)
    SELECT x.source, x.target, old_kind AS kind, false AS active, 'user' AS origin FROM x JOIN rel r ON r.source = x.source AND r.target = x.target AND r.kind = old_kind
    UNION ALL SELECT x.source, x.target, new_kind, true, 'user' FROM x LEFT JOIN rel r ON r.source = x.source AND r.target = x.target AND r.kind = new_kind WHERE new_kind IS NOT NULL AND r.version IS NULL""")
def relation_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second lines of orders as edits from one kind to another, or to none."""
    line, k = table(spark, sf_dir, "lineitem").where("l_linenumber = 2"), F.col("l_partkey")
    edits = line.select(k.alias("source"), (F.col("l_suppkey") + _S).alias("target"), (k % 3).cast("int").alias("old_kind"), F.when(k % 5 != 0, (k % 4).cast("int")).alias("new_kind")).distinct()
    return m.relation_edits(g.current_relations(_log(spark, sf_dir)), edits)


@query("replace_memory", f"""WITH {_LOG_SQL}, rp AS (SELECT p_partkey AS old, p_partkey + {2 * _S} AS new FROM part WHERE p_size = 7)
    SELECT DISTINCT coalesce(a.new, r.source) AS source, r.target, r.kind FROM rel r JOIN rp a ON a.old = r.source
    UNION SELECT new, old, {m.SUPERSEDES} FROM rp""")
def replace_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of size 7 replaced: the new ones' edges."""
    over = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 2 * _S).alias("new"))
    return m.replaced(g.current_relations(_log(spark, sf_dir)), over)


@query("publish_pair", f"""WITH {_LOG_SQL}, pr AS (SELECT DISTINCT l_partkey AS a, l_suppkey + {_S} AS b, CAST(l_partkey % 3 AS INTEGER) AS kind, CASE l_partkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'ab' ELSE 'ba' END AS direction, l_partkey % 2 = 0 AS present FROM lineitem WHERE l_linenumber = 3),
    w AS (SELECT a AS source, b AS target, kind, present FROM pr WHERE direction <> 'ba' UNION SELECT b, a, kind, present FROM pr WHERE direction <> 'ab')
    SELECT w.source, w.target, w.kind, present AS active FROM w LEFT JOIN now n USING (source, target, kind) WHERE coalesce(n.active, false) <> present AND n.origin IS DISTINCT FROM 'user'""")
def publish_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pairs of parts and suppliers, in one direction or both."""
    line, k = table(spark, sf_dir, "lineitem").where("l_linenumber = 3"), F.col("l_partkey")
    pairs = line.select(k.alias("a"), (F.col("l_suppkey") + _S).alias("b"), (k % 3).cast("int").alias("kind"), F.when(k % 3 == 0, "both").when(k % 3 == 1, "ab").otherwise("ba").alias("direction"), (k % 2 == 0).alias("present")).distinct()
    return m.pair_mutations(_log(spark, sf_dir), pairs)


@query("shortest_path", """
    WITH RECURSIVE n AS (SELECT max(p_partkey) AS n FROM part),
    e AS (SELECT DISTINCT p_partkey AS s, unnest([(p_partkey * 2) % n + 1, (p_partkey + p_size) % n + 1]) AS t FROM part, n),
    d(start, node, nodes) AS (SELECT p_partkey, p_partkey, [p_partkey] FROM part WHERE p_partkey IN (1, 50, 99)
        UNION ALL SELECT d.start, e.t, list_append(d.nodes, e.t) FROM d JOIN e ON e.s = d.node WHERE len(d.nodes) <= 5),
    b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY len(nodes), nodes) = 1)
    SELECT start, node, array_to_string(nodes, '>') AS nodes, repeat('1', CAST(len(nodes) - 1 AS INTEGER)) AS kinds FROM b""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes and kinds on the way from three parts, at most five steps."""
    starts = table(spark, sf_dir, "part").where("p_partkey in (1, 50, 99)").select(F.col("p_partkey").alias("start"))
    p = m.shortest_paths(_steps(spark, sf_dir), starts, 5)
    return p.select("start", "node", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("nodes"), F.array_join(F.transform("kinds", lambda x: x.cast("string")), "").alias("kinds"))


@query("snapshot_validation", """
    WITH mb AS (SELECT label AS community, vec_id AS node FROM embeddings WHERE vec_id % 17 <> 0 UNION ALL SELECT label, vec_id FROM embeddings WHERE vec_id % 50 = 1
                UNION ALL SELECT label + 1, vec_id FROM embeddings WHERE vec_id % 40 = 2 UNION ALL SELECT 0, -5)
    SELECT 'several communities' AS error, CAST(node AS VARCHAR) AS key FROM mb GROUP BY node HAVING count(DISTINCT community) > 1
    UNION ALL SELECT DISTINCT 'listed twice', CAST(node AS VARCHAR) FROM mb GROUP BY community, node HAVING count(*) > 1
    UNION ALL SELECT 'unknown', '-5' UNION ALL SELECT 'uncovered', CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id NOT IN (SELECT node FROM mb)""")
def snapshot_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot with every kind of fault: members left out, repeated, in two communities, unknown."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("community"), F.col("vec_id").alias("node"))
    faulty = e.where("node % 17 <> 0").union(e.where("node % 50 = 1")).union(e.where("node % 40 = 2").withColumn("community", F.col("community") + 1)).union(spark.createDataFrame([(0, -5)], "community int, node long"))
    return m.snapshot_errors(faulty, e.select("node"), current=True)


@query("community_refresh", "SELECT label AS community, count(*) AS members FROM embeddings GROUP BY 1")
def community_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A current snapshot is returned as it is, an old one made anew; here from the first to the second."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("community"), F.col("vec_id").alias("node"))
    old = m.refreshed(e.where("node % 2 = 0"), 3, 4, lambda: e)
    return m.refreshed(old, 4, 4, lambda: e.limit(0)).groupBy("community").agg(F.count("*").alias("members"))


@query("naming_pass", """
    WITH c AS (SELECT label AS community, count(*) AS members FROM embeddings GROUP BY 1), w AS (SELECT *, row_number() OVER (ORDER BY community) AS k, count(*) OVER () AS n FROM c WHERE community % 3 <> 0)
    SELECT community, 'community of ' || members AS name, n - 4 AS remaining FROM w WHERE k <= 4""")
def naming_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without a name (those that three doesn't divide) named by a stand-in model, four at a time."""
    e = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("community")).agg(F.count("*").alias("members"))
    names = e.where("community % 3 = 0").select("community", F.lit("old").alias("name"))
    named, left = m.naming_pass(e, names, 4, lambda df: df.select("community", F.concat(F.lit("community of "), "members").alias("name")))
    return named.crossJoin(left)  # one row


_REPRESENT_SQL = f"""ce(community, place, centroid) AS (SELECT label, vec_id % 2, list_transform(list(embedding ORDER BY vec_id)[1], lambda x: CAST(x AS DOUBLE)) FROM embeddings GROUP BY 1, 2),
    sc AS (SELECT e.label AS community, e.vec_id AS id, ce.place, round({_COS.format("e.embedding", "ce.centroid")}, 9) AS score FROM embeddings e JOIN ce ON ce.community = e.label),
    n AS (SELECT *, row_number() OVER (PARTITION BY community, place ORDER BY score DESC, id) AS k FROM sc),
    b AS (SELECT community, id, bool_or(k <= 2) AS first, max(score) AS best FROM n GROUP BY 1, 2)"""


@query("naming_representatives", f"WITH {_REPRESENT_SQL} SELECT community, id FROM b QUALIFY row_number() OVER (PARTITION BY community ORDER BY first DESC, best DESC, id) <= 8")
def naming_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors a label, two of them for each of its sub-centroids (its first even and odd vector)."""
    e = _vectors(spark, sf_dir).withColumnRenamed("label", "community")
    centres = e.groupBy("community", (F.col("id") % 2).alias("place")).agg(F.min_by("vector", "id").alias("centroid"))
    return m.representatives(e, centres)


@query("name_walk", """
    WITH x AS (SELECT * FROM (VALUES (0, 'user'), (1, 'model'), (2, 'model')) v(k, source)), s AS (SELECT label, k, source FROM (SELECT DISTINCT label FROM embeddings) JOIN x ON label % 3 = k),
    m AS (SELECT label, count(*) FILTER (WHERE r < 80) AS n0, count(*) FILTER (WHERE r < 90) AS n1, count(*) FILTER (WHERE r < 100) AS n2, count(*) FILTER (WHERE r < 110) AS n3 FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) % 120 AS r FROM embeddings) GROUP BY 1),
    g AS (SELECT label, source, unnest([0, 1, 2, 3]) AS generation, unnest([n0, n1, n2, n3]) AS n, n0, list_min([n0 * 1000 // n1, 1000]) AS j1, n0 * 1000 // n2 AS j2, n0 * 1000 // n3 AS j3 FROM s JOIN m USING (label))
    SELECT CAST(generation AS INTEGER) AS generation, label AS community, 'L' || label AS name, source, CAST(0 AS INTEGER) AS baseline FROM g
    WHERE source = 'user' OR generation = 0 OR (generation = 1 AND j1 >= 750) OR (generation = 2 AND j1 >= 750 AND j2 >= 750) OR (generation = 3 AND j1 >= 750 AND j2 >= 750 AND j3 >= 750)""")
def name_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that grow over four generations: users' names stay, models' go once less than three quarters
    are shared with the community that was named."""
    e = table(spark, sf_dir, "embeddings").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) % 120).select(F.col("label").alias("community"), F.col("vec_id").alias("node"), "r")
    generations = [e.where(F.col("r") < n).select("community", "node") for n in (80, 90, 100, 110)]
    names = e.select(F.lit(0).alias("generation"), "community", F.concat(F.lit("L"), "community").alias("name"), F.when(F.col("community") % 3 == 0, "user").otherwise("model").alias("source")).distinct()
    return m.inherited(generations, names)
