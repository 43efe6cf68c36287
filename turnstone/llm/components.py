"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Rounds after which something must be wrong: ways to a root about halve in each.
MOST_ROUNDS = 64


def _both_ways(edges: DataFrame) -> DataFrame:
    """(v, u) for either direction of edges (lo, hi)."""
    return edges.select(F.col("lo").alias("v"), F.col("hi").alias("u")).union(edges.select(F.col("hi").alias("v"), F.col("lo").alias("u")))


def _told(now: DataFrame, least: DataFrame) -> DataFrame:
    """Each neighbour of a node v, and v itself, are linked with the least node m of them. now: edges (lo,
    hi); least: (v, m). open: v was neither m nor linked with m alone."""
    known = _both_ways(now).join(least, "v").select("m", F.col("u").alias("w"), ((F.col("v") != F.col("m")) & (F.col("u") != F.col("m"))).alias("open"))
    ends = known.union(least.select("m", F.col("v").alias("w"), F.lit(False))).where("m <> w")
    return ends.groupBy(F.least("m", "w").alias("lo"), F.greatest("m", "w").alias("hi")).agg(F.max("open").alias("open"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node that it is linked with.

    Each node has a set of nodes, at first its neighbours. In a round the least of it comes to know
    all of it and all of it the least, until every node knows only its root. The least nodes are
    found by an aggregate, which adds up in each task first, and are written, so that the join that
    hands them out is a broadcast where Spark finds them small, and else one whose large keys (the
    root of a large component) adaptive execution splits. Loops and repeated edges are allowed and
    give no nodes of their own; edges with a null end are left out.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        least = written(_both_ways(now).groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("m")), "least")
        now = written(_told(now.select("lo", "hi"), least), "components", instead_of=now)
        forget(least)
        if now.where("open").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
