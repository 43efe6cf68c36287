"""Upkeep of the graph and its communities: edits by users, replaced statements, published pairs, paths,
snapshots, names that are inherited, missing or represented."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..session import cut
from .communities import lineage, overlaps
from .graph import EDGE

# Kinds of relations.
SUPERSEDES, ENTITY_ASSOCIATION = 7, 100
#: A model's name is inherited from so many thousandths on, against the community that was named.
LEAST_INHERITED = 750


def memory_projection(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, nodes): the current active relations between statements, and the statements (node)
    that ever had one."""
    between = log.where(F.col("kind") != ENTITY_ASSOCIATION)
    now = between.groupBy(*EDGE).agg(F.max_by("active", "version").alias("active")).where("active").drop("active")
    nodes = between.select(F.col("source").alias("node")).union(between.select("target")).distinct()
    return now, nodes


def relation_edits(current: DataFrame, edits: DataFrame) -> DataFrame:
    """(source, target, kind, active, origin): what a user's edits (source, target, old_kind, new_kind)
    append: the old kind off if it is on, the new one on if it isn't; null for neither. An edit to the
    same kind changes nothing."""
    real = edits.where(~F.col("old_kind").eqNullSafe(F.col("new_kind")))
    off = real.select("source", "target", F.col("old_kind").alias("kind")).where("kind is not null").distinct().join(current.select(*EDGE), EDGE, "left_semi").withColumn("active", F.lit(False))
    on = real.select("source", "target", F.col("new_kind").alias("kind")).where("kind is not null").distinct().join(current.select(*EDGE), EDGE, "left_anti").withColumn("active", F.lit(True))
    return off.union(on).withColumn("origin", F.lit("user"))


def replaced(current: DataFrame, replacements: DataFrame) -> DataFrame:
    """(source, target, kind): the edges that new statements get which replace old ones (old, new): all
    of the old one's, at either end, and one that supersedes it. An edge between two that are replaced
    joins the new ones."""
    to = lambda df, c: df.join(replacements.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left")
    moved = to(current.select(*EDGE), "source").withColumn("_s", F.col("_new")).drop("_new")
    moved = to(moved, "target").where(F.col("_s").isNotNull() | F.col("_new").isNotNull())
    heirs = moved.select(F.coalesce("_s", "source").alias("source"), F.coalesce("_new", "target").alias("target"), "kind").where("source <> target")
    over = replacements.select(F.col("new").alias("source"), F.col("old").alias("target"), F.lit(SUPERSEDES).cast(dict(current.dtypes)["kind"]).alias("kind"))
    return heirs.union(over).distinct()


def pair_mutations(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, kind, active): what judged pairs (a, b, kind, direction, present) append. Direction
    `both` stands for an edge each way, `ab` and `ba` for one. An edge whose last state a user set is
    left alone, and so is one that is as it should be."""
    ends = F.when(F.col("direction") == "both", F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).when(F.col("direction") == "ab", F.array(F.struct("a", "b"))).otherwise(F.array(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    wanted = pairs.select(F.explode(ends).alias("e"), "kind", "present").select(F.col("e.a").alias("source"), F.col("e.b").alias("target"), "kind", "present").distinct()
    now = log.groupBy(*EDGE).agg(F.max_by(F.struct("active", "origin"), "version").alias("_now"))
    both = wanted.join(now, EDGE, "left")
    is_on = F.coalesce("_now.active", F.lit(False))
    return both.where((is_on != F.col("present")) & ~F.coalesce(F.col("_now.origin") == "user", F.lit(False))).select(*EDGE, F.col("present").alias("active"))


def shortest_paths(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, nodes, kinds): a shortest directed path of at most `most` steps from each start to each
    node; of several, the one with the least nodes and then kinds in order. A level at a time: a node's
    path goes on from the paths that reached its level, each kept once."""
    step = cut(edges.groupBy(F.col("source").alias("node"), F.col("target").alias("next")).agg(F.min("kind").alias("kind")), "steps")
    kind = dict(step.dtypes)["kind"]
    seen = cut(starts.select("start", F.col("start").alias("node"), F.array("start").alias("nodes"), F.array().cast(f"array<{kind}>").alias("kinds")), "paths")
    level = seen
    for _ in range(most):
        on = level.join(step, "node").select("start", F.col("next").alias("node"), F.struct(F.array_append("nodes", F.col("next")).alias("nodes"), F.array_append("kinds", F.col("kind")).alias("kinds")).alias("p"))
        best = on.groupBy("start", "node").agg(F.min("p").alias("p")).select("start", "node", "p.nodes", "p.kinds")
        level = cut(best.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "paths")
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen


def snapshot_errors(members: DataFrame, nodes: DataFrame, current: bool) -> DataFrame:
    """(error, key): nodes in several communities (community, node), nodes listed twice in one, unknown
    ones, and, if the snapshot is current, nodes (node) that no community covers."""
    key = lambda df, name, c: df.select(F.lit(name).alias("error"), F.col(c).cast("string").alias("key"))
    several = members.groupBy("node").agg(F.count_distinct("community").alias("n")).where("n > 1")
    twice = members.groupBy("community", "node").count().where("count > 1").select("node").distinct()
    out = key(several, "several communities", "node").union(key(twice, "listed twice", "node"))
    out = out.union(key(members.join(nodes, "node", "left_anti").select("node").distinct(), "unknown", "node"))
    return out.union(key(nodes.join(members, "node", "left_anti"), "uncovered", "node")) if current else out


def refreshed(snapshot: DataFrame, version: int, current: int, detect: Callable[[], DataFrame]) -> DataFrame:
    """The snapshot (community, node), made anew by detect only if the graph has moved on from its version."""
    return snapshot if version == current else detect().select("community", "node")


def naming_pass(communities: DataFrame, names: DataFrame, most: int, model: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(named, remaining): names (community, name) by a model for the first `most` communities (community,
    ...) without one, and one row with the number of those that are left."""
    without = communities.join(names.select("community"), "community", "left_anti")
    first = cut(without.orderBy("community").limit(most), "unnamed")
    left = without.join(first.select("community"), "community", "left_anti").agg(F.count("*").alias("remaining"))
    return model(first), left


def representatives(vectors: DataFrame, centroids: DataFrame, each: int = 2, most: int = 8) -> DataFrame:
    """(community, id): the `each` statements (community, id, vector) nearest to each sub-centroid
    (community, place, centroid), filled up to `most` with those nearest to any."""
    scores = vectors.join(centroids, "community").select("community", "id", "place", F.round(cosine(F.col("vector"), F.col("centroid")), 9).alias("score")).where("score is not null")
    near = F.row_number().over(Window.partitionBy("community", "place").orderBy(F.desc("score"), "id"))
    by_id = scores.withColumn("_n", near).groupBy("community", "id").agg(F.max(F.col("_n") <= each).alias("_first"), F.max("score").alias("_best"))
    order = Window.partitionBy("community").orderBy(F.desc("_first"), F.desc("_best"), "id")
    return by_id.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select("community", "id")


def inherited(generations: list[DataFrame], named: DataFrame, least: int = LEAST_INHERITED) -> DataFrame:
    """(generation, community, name, source, baseline): names through generations of communities
    (community, node), oldest first. named: (generation, community, name, source) as given.

    A name goes on along continuations. A user's always does; a model's if the community shares at
    least so many thousandths with the one that was named, the baseline, however long ago.
    """
    of = lambda g: named.where(F.col("generation") == g).select(F.lit(g).alias("generation"), "community", "name", "source", F.lit(g).alias("baseline"), F.col("community").alias("_at"))
    now = cut(of(0), "names")
    out = now
    for g in range(1, len(generations)):
        go = lineage(generations[g - 1], generations[g]).where("continuation").select(F.col("old").alias("community"), "new")
        moved = cut(now.join(go, "community").select("new", "name", "source", "baseline", "_at"), "moved")
        keep = moved.where("source = 'user'")
        for b in range(g):  # a baseline for each earlier generation
            near = overlaps(generations[b], generations[g]).where(F.col("jaccard") >= least).select(F.col("old").alias("_at"), "new")
            keep = keep.union(moved.where((F.col("source") != "user") & (F.col("baseline") == b)).join(near, ["_at", "new"], "left_semi").select(*keep.columns))
        fresh = of(g)
        heirs = keep.select(F.lit(g).alias("generation"), F.col("new").alias("community"), "name", "source", "baseline", "_at").join(fresh.select("community"), "community", "left_anti")
        now = cut(fresh.unionByName(heirs), "names")
        out = out.unionByName(now)
    return out.drop("_at")
