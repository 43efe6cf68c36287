"""Queries over communities: labels of embeddings, a graph of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import clustering as k
from ..operators import communities as c
from ..operators import vectors as v
from .graph import _steps
from .vectors import _query, _vectors

_GENERATIONS_SQL = """b AS (SELECT label AS community, vec_id AS node FROM embeddings WHERE vec_id % 10 <> 0),
    a AS (SELECT CASE WHEN label = 3 AND vec_id % 2 = 0 THEN 20 WHEN label = 5 THEN 4 ELSE label END AS community, vec_id AS node FROM embeddings WHERE label <> 9),
    o AS (SELECT b.community AS old, a.community AS new, count(*) AS common FROM b JOIN a USING (node) GROUP BY 1, 2),
    j AS (SELECT old, new, common, common * 1000 // ((SELECT count(*) FROM b WHERE community = old) + (SELECT count(*) FROM a WHERE community = new) - common) AS jaccard FROM o)"""


def _generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels as communities; then 3 splits, 5 joins 4, and 9 is gone."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("community"), F.col("vec_id").alias("node"))
    now = F.when((F.col("community") == 3) & (F.col("node") % 2 == 0), 20).when(F.col("community") == 5, 4).otherwise(F.col("community"))
    return e.where("node % 10 <> 0"), e.where("community <> 9").withColumn("community", now)


@query("lineage", f"""WITH {_GENERATIONS_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY old) > 1 AS split, count(*) OVER (PARTITION BY new) > 1 AS merge,
        rank() OVER (PARTITION BY old ORDER BY jaccard DESC) AS ro, rank() OVER (PARTITION BY new ORDER BY jaccard DESC) AS rn FROM j)
    SELECT old, new, common, jaccard, split, merge, ro = 1 AND rn = 1 AND count(*) FILTER (WHERE ro = 1) OVER (PARTITION BY old) = 1
           AND count(*) FILTER (WHERE rn = 1) OVER (PARTITION BY new) = 1 AS continuation FROM r""")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.lineage(*_generations(spark, sf_dir))


@query("lineage_ends", f"""WITH {_GENERATIONS_SQL}
    SELECT DISTINCT community, 'new' AS state FROM a WHERE community NOT IN (SELECT new FROM j)
    UNION ALL SELECT DISTINCT community, 'ended' FROM b WHERE community NOT IN (SELECT old FROM j)""")
def lineage_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.new_and_ended(*_generations(spark, sf_dir))


@query("community_ids", """
    SELECT label AS community, sha256('owner:' || string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id)) AS id, count(*) AS members FROM embeddings GROUP BY label""")
def community_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.community_ids(table(spark, sf_dir, "embeddings").select(F.col("label").alias("community"), F.col("vec_id").alias("node")), "owner")


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = v.mean_vectors(_vectors(spark, sf_dir), "label")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda s: s["mean"])
    return mean.groupBy(F.col("label").alias("community")).agg(listed.alias("centroid"))


_ROUTE_SQL = """m AS (SELECT label, unnest(range(len(embedding))) AS p, unnest(embedding) AS x FROM embeddings),
    mm AS (SELECT label, p, avg(CAST(x AS DOUBLE)) AS x FROM m GROUP BY 1, 2), ce AS (SELECT label AS community, list(x ORDER BY p) AS centroid FROM mm GROUP BY 1),
    sc AS (SELECT q.vec_id AS query_id, community, round(list_cosine_similarity(centroid, CAST(q.embedding AS DOUBLE[])), 9) AS score FROM ce, embeddings q WHERE q.vec_id IN (0, 7, 11)),
    ro AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS rank FROM sc QUALIFY rank <= 4)"""


@query("routing_topk", f"WITH {_ROUTE_SQL} SELECT query_id, community, score, rank FROM ro")
def routing_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four communities whose mean is nearest to each query."""
    return c.routed(_centroids(spark, sf_dir), _query(spark, sf_dir, [0, 7, 11]))


@query("admission_with_residual", f"""WITH {_ROUTE_SQL}, it AS (SELECT vec_id AS id, CASE WHEN vec_id % 13 <> 0 THEN label END AS community FROM embeddings)
    SELECT query_id, id FROM it JOIN ro USING (community) UNION ALL SELECT query_id, id FROM it, (SELECT DISTINCT query_id FROM ro) WHERE community IS NULL""")
def admission_with_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the routed communities, and every 13th, which has none."""
    items = _vectors(spark, sf_dir).select("id", F.when(F.col("id") % 13 != 0, F.col("label")).alias("community"))
    return c.admitted(items, routing_topk(spark, sf_dir))


@query("subcentroids")
def subcentroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select(F.col("label").alias("community"), "id", "vector")
    return c.sub_centroids(rows).select("community", "place", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of parts; every 50th part is linked with nothing but the next."""
    return _steps(spark, sf_dir).select(F.col("source").alias("a"), F.col("target").alias("b")).where("a % 50 <> 0 AND b % 50 <> 0").union(
        table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey"), F.col("p_partkey") + 50)
    )


_GRAPH_SQL = """n AS (SELECT max(p_partkey) AS n FROM part),
    s AS (SELECT p_partkey AS s, unnest([(p_partkey * 2) % n + 1, (p_partkey + p_size) % n + 1]) AS t FROM part, n),
    e AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM s WHERE s <> t AND s % 50 <> 0 AND t % 50 <> 0
          UNION SELECT p_partkey, p_partkey + 50 FROM part WHERE p_partkey % 100 = 0),
    w AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e)"""

#: Breadth first: what is reached from each node gives the roots, steps from these the levels, and
#: each level is ordered by the first neighbour on the one before.
_ORDER_SQL = f"""WITH RECURSIVE {_GRAPH_SQL}, r(node, other) AS (SELECT x, x FROM w UNION SELECT r.node, w.y FROM r JOIN w ON w.x = r.other),
    c AS (SELECT node, min(other) AS root FROM r GROUP BY node),
    d(root, node, level) AS (SELECT node, node, 0 FROM c WHERE node = root UNION SELECT d.root, w.y, d.level + 1 FROM d JOIN w ON w.x = d.node WHERE d.level < 40),
    l AS (SELECT root, node, min(level) AS level FROM d GROUP BY root, node),
    o(root, node, level, place) AS (
        SELECT root, node, 0, CAST(1 AS BIGINT) FROM c WHERE node = root
        UNION ALL SELECT root, node, level, row_number() OVER (PARTITION BY root ORDER BY parent, node) FROM (
            SELECT l.root, l.node, l.level, min(o.place) AS parent FROM o JOIN w ON w.x = o.node JOIN l ON l.node = w.y AND l.level = o.level + 1 GROUP BY l.root, l.node, l.level)),
    p AS (SELECT node, root, level, row_number() OVER (ORDER BY root, level, place) - 1 AS position FROM o)"""


@query("scan_order", f"{_ORDER_SQL} SELECT node, root, level, position FROM p")
def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breadth-first walk over the graph of parts."""
    return k.scan_order(_graph(spark, sf_dir))


@query("scan_plan", f"""{_ORDER_SQL}, h AS (SELECT node, position // 64 AS shard FROM p),
    f AS (SELECT e.a, e.b, x.shard AS sa, xor(x.shard, y.shard) AS apart FROM e JOIN h x ON x.node = e.a JOIN h y ON y.node = e.b),
    v AS (SELECT *, CASE WHEN apart = 0 THEN 0 ELSE length(bin(apart)) END AS level FROM f)
    SELECT a, b, level, sa >> CAST(level AS BIGINT) AS parent FROM v""")
def scan_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region at which each edge is taken into account, for shards of 64 parts."""
    edges = _graph(spark, sf_dir)
    return k.scan_plan(edges, k.scan_order(edges), shard=64)


@query("leiden")
def leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the graph of parts."""
    return k.scan_and_merge(_graph(spark, sf_dir), shard=256)[0]


@query("leiden_report", f"""WITH {_GRAPH_SQL}
    SELECT count(DISTINCT x) AS nodes, CAST(0 AS BIGINT) AS misnamed, CAST(0 AS BIGINT) AS broken, true AS grows, true AS best_merges_done FROM w""")
def leiden_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any good result: all nodes have one community, which is connected and named by
    its least node; no step lost modularity; no two linked communities gain by merging."""
    edges = _graph(spark, sf_dir)
    home, grades = k.scan_and_merge(edges, shard=256)
    report = k.partition_report(edges, home).join(home.agg(F.count_distinct("community").alias("n")))  # one row each
    gaining = k.gains(edges, home).where("gain > 1e-6").agg((F.count("*") == 0).alias("best_merges_done"))
    grows = all(x <= y for x, y in zip(grades, grades[1:], strict=False)) and len(grades) > 1
    return report.join(gaining).select("nodes", (F.col("n") - F.col("named_by_least")).alias("misnamed"), (F.col("parts") - F.col("n")).alias("broken"), F.lit(grows).alias("grows"), "best_merges_done")


@query("modularity_of_labels", """
    WITH n AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT DISTINCT least(vec_id, vec_id * 7 % n) AS a, greatest(vec_id, vec_id * 7 % n) AS b FROM embeddings, n WHERE vec_id <> vec_id * 7 % n),
    l AS (SELECT x.label AS ca, y.label AS cb FROM e JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b),
    d AS (SELECT ca AS c, CAST(ca = cb AS INT) AS i FROM l UNION ALL SELECT cb, 0 FROM l), p AS (SELECT c, sum(i) AS inside, count(*) AS degree FROM d GROUP BY c),
    m AS (SELECT sum(degree) / 2 AS m FROM p)
    SELECT round(sum(inside / m - (degree / (2 * m)) ** 2), 9) AS modularity, count(*) AS communities, CAST(any_value(m) AS DOUBLE) AS edges FROM p, m""")
def modularity_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph over all vectors: each is linked with the one of seven times its number."""
    e = table(spark, sf_dir, "embeddings")
    e = e.select("vec_id").crossJoin(e.agg(F.count("*").alias("n"))).withColumn("to", F.expr("vec_id * 7 % n")).where("vec_id <> to")  # n: one row
    pairs = e.select(F.least("vec_id", "to").alias("a"), F.greatest("vec_id", "to").alias("b")).distinct()
    home = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("community"))
    return c.modularity(pairs, home).select(F.round("modularity", 9).alias("modularity"), "communities", "edges")
