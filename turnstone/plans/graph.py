"""Queries over a typed graph: lines link parts and suppliers, and parts of one order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import graph as g

#: Suppliers are numbered after all parts.
_S = 10**9


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as mutations of part -> supplier edges; returned lines switch an edge off."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("version"), F.col("l_partkey").alias("source"), (F.col("l_suppkey") + _S).alias("target"),
        (F.col("l_partkey") % 3).cast("int").alias("kind"), (F.col("l_returnflag") != "R").alias("active"), F.when(F.col("l_linenumber") == 1, "user").otherwise("dream").alias("origin"),
    )


_LOG_SQL = f"""log AS (SELECT l_orderkey * 8 + l_linenumber AS version, l_partkey AS source, l_suppkey + {_S} AS target,
    CAST(l_partkey % 3 AS INTEGER) AS kind, l_returnflag <> 'R' AS active, CASE WHEN l_linenumber = 1 THEN 'user' ELSE 'dream' END AS origin FROM lineitem),
    now AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY source, target, kind ORDER BY version DESC) = 1),
    rel AS (SELECT * FROM now WHERE active)"""


@query("current_relations", f"WITH {_LOG_SQL} SELECT source, target, kind, version, origin FROM rel")
def current_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.current_relations(_log(spark, sf_dir)).select("source", "target", "kind", "version", "origin")


@query("relation_state", f"WITH {_LOG_SQL} SELECT source, target, kind, active, version FROM now WHERE source = 7")
def relation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.latest(_log(spark, sf_dir).where("source = 7"), g.EDGE, "version").select("source", "target", "kind", "active", "version")


@query("neighbors_out", f"WITH {_LOG_SQL} SELECT source AS node, target AS neighbor, kind FROM rel WHERE source % 10 = 1")
def neighbors_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")).where("node % 10 = 1")
    return g.neighbors(g.current_relations(_log(spark, sf_dir)), asked, "out")


@query("neighbors_in", f"WITH {_LOG_SQL} SELECT target AS node, source AS neighbor, kind FROM rel WHERE target % 10 = 3")
def neighbors_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + _S).alias("node")).where("node % 10 = 3")
    return g.neighbors(g.current_relations(_log(spark, sf_dir)), asked, "in")


@query("structural_edges", f"WITH {_LOG_SQL} SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM rel")
def structural_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.structural_edges(g.current_relations(_log(spark, sf_dir)))


@query("degree", f"""WITH {_LOG_SQL}, p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM rel),
    n AS (SELECT a AS node FROM p UNION ALL SELECT b FROM p) SELECT node, count(*) AS degree FROM n GROUP BY node""")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.degrees(g.structural_edges(g.current_relations(_log(spark, sf_dir))))


@query("graph_stats", f"""WITH {_LOG_SQL} SELECT kind, count(*) AS relations, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets,
    count(*) FILTER (WHERE origin = 'user') AS by_user FROM rel GROUP BY kind""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = g.current_relations(_log(spark, sf_dir))
    return r.groupBy("kind").agg(F.count("*").alias("relations"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"), F.count_if(F.col("origin") == "user").alias("by_user"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges among parts: each part leads to two others."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.col("p_size").cast("long").alias("size"))
    n = p.agg(F.max("source").alias("n"))
    both = p.crossJoin(F.broadcast(n)).withColumn("to", F.array((F.col("source") * 2) % F.col("n") + 1, (F.col("source") + F.col("size")) % F.col("n") + 1))  # n: one row
    return both.select("source", F.explode("to").alias("target"), F.lit(1).alias("kind"))


@query("shortest_path_len", """
    WITH RECURSIVE n AS (SELECT max(p_partkey) AS n FROM part),
    e AS (SELECT DISTINCT p_partkey AS s, unnest([(p_partkey * 2) % n + 1, (p_partkey + p_size) % n + 1]) AS t FROM part, n),
    d(start, node, depth) AS (
        SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey IN (1, 50, 99)
        UNION SELECT d.start, e.t, d.depth + 1 FROM d JOIN e ON e.s = d.node WHERE d.depth < 5)
    SELECT start, node, min(depth) AS depth FROM d GROUP BY start, node""")
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest steps from three parts, at most five."""
    starts = table(spark, sf_dir, "part").where("p_partkey in (1, 50, 99)").select(F.col("p_partkey").alias("start"))
    return g.distances(_steps(spark, sf_dir), starts, 5)


@query("entity_associations", """
    SELECT s_suppkey AS entity, count(DISTINCT o_custkey) AS members, min(o_custkey) AS first_member
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def entity_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (memories) that a supplier (entity) is associated with."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    links = line.join(o, "l_orderkey").select(F.col("l_suppkey").alias("entity"), "o_custkey").distinct()
    return links.groupBy("entity").agg(F.count("*").alias("members"), F.min("o_custkey").alias("first_member"))


@query("edge_changes", f"""
    WITH {_LOG_SQL}, want AS (SELECT DISTINCT l_partkey AS source, l_suppkey + {_S} AS target, CAST(l_partkey % 3 AS INTEGER) AS kind FROM lineitem WHERE l_quantity > 25)
    SELECT w.*, true AS active FROM want w LEFT JOIN rel r USING (source, target, kind) WHERE r.version IS NULL
    UNION ALL SELECT r.source, r.target, r.kind, false FROM rel r LEFT JOIN want w USING (source, target, kind)
    WHERE w.source IS NULL AND r.origin <> 'user'""")
def edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the current edges to those of large lines; edges that a user set stay."""
    want = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + _S).alias("target"), (F.col("l_partkey") % 3).cast("int").alias("kind")).distinct()
    return g.edge_changes(g.current_relations(_log(spark, sf_dir)), want, "user")


@query("effective_mutations", f"""
    WITH {_LOG_SQL}, c AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY source, target, kind ORDER BY version), false) AS was FROM log)
    SELECT version, source, target, kind, active FROM c WHERE active <> was""")
def effective_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations that change an edge; the rest are no-ops."""
    return g.with_previous(_log(spark, sf_dir)).where("changes").select("version", "source", "target", "kind", "active")


@query("graph_components", """
    WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem),
    l AS (SELECT b, min(a) AS a FROM e GROUP BY b),
    s AS (SELECT DISTINCT l.a AS x, e.a AS y FROM e JOIN l USING (b)), p AS (SELECT x, y FROM s UNION SELECT y, x FROM s),
    r(node, other) AS (SELECT x, x FROM p UNION SELECT r.node, p.y FROM r JOIN p ON p.x = r.other),
    m AS (SELECT node, min(other) AS root FROM r GROUP BY node)
    SELECT node, root FROM m UNION ALL SELECT l.b, m.root FROM l JOIN m ON m.node = l.a""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts and suppliers that lines link. (The SQL links each supplier's parts with its first.)"""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + _S).alias("b"))
    return g.components(e)


@query("graph_expansion")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-first expansion from the three parts, with brands as communities."""
    p = table(spark, sf_dir, "part")
    home = p.select(F.col("p_partkey").alias("node"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("community"))
    seeds = p.where("p_partkey in (1, 50, 99)").select((F.col("p_partkey") % 2).alias("query_id"), F.col("p_partkey").alias("node"), F.lit(1).alias("place"))
    return g.expansion(_steps(spark, sf_dir), seeds, home)


@query("set_relations", f"""WITH {_LOG_SQL}, w AS (SELECT p_partkey AS source, p_partkey % 7 + {_S} AS target, CAST(p_partkey % 3 AS INTEGER) AS kind, p_size % 2 = 0 AS active, 'user' AS origin FROM part
        UNION ALL SELECT p_partkey, p_partkey % 7 + {_S}, CAST(p_partkey % 3 AS INTEGER), true, 'dream' FROM part WHERE p_partkey % 10 = 4)
    SELECT w.source, w.target, w.kind, w.active, w.origin, CASE WHEN count(*) OVER (PARTITION BY w.source, w.target, w.kind) > 1 THEN 'repeated' WHEN n.version IS NULL AND NOT w.active THEN 'absent'
           WHEN n.active = w.active AND n.origin = w.origin THEN 'equal' ELSE 'set' END AS outcome FROM w LEFT JOIN now n USING (source, target, kind)""")
def set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of edges from each part to a supplier, some of them twice."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    edge = [k.alias("source"), (k % 7 + _S).alias("target"), (k % 3).cast("int").alias("kind")]
    w = p.select(*edge, (F.col("p_size") % 2 == 0).alias("active"), F.lit("user").alias("origin")).union(p.where(k % 10 == 4).select(*edge, F.lit(True), F.lit("dream")))
    return g.set_relations(_log(spark, sf_dir), w, 5, 5)
