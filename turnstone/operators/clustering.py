"""Communities by scan and merge: a breadth-first order deals nodes to shards, each shard is
clustered by itself, and what shards found is merged over the whole graph by joins.

Inside a shard of a bounded size the Leiden steps are taken node by node: local moves, a refinement
that only joins neighbours, the refined groups as nodes of a smaller graph. Regions merge in
pairs as long as what they found fits a task. Over the whole graph steps are taken by all groups at
once: each group picks the partner that gains most, a drawn rank tells who is joined by others, and
those that join one centre are only let in if the gain is there in whatever order they come. Merging along edges keeps communities connected;
after nodes have moved, a community that fell apart becomes several. No task sees all groups.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import components
from .order import in_runs, numbered

#: Nodes of a shard, and rounds after which something must be wrong.
SHARD, MOST_ROUNDS = 2048, 400


# -- the order and the plan ---------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b; loops and nulls are left out."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a"))


def scan_order(edges: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """(node, root, level, position) of a breadth-first walk over undirected edges (a, b).

    Components follow each other by their least node, from which each is walked; nodes of a level
    come by the first of their neighbours on the level before, then by themselves. alone: (node)
    without edges, which are components too. A level is one join of its nodes with the edges, so the
    rounds are as many as the longest of the shortest ways from a root.
    """
    pairs = cut(undirected(edges), "pairs")
    both = cut(_both_ways(pairs), "both")
    roots = components(pairs)
    if alone is not None:
        roots = roots.union(alone.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")).distinct())
    roots = cut(roots, "roots")
    now = cut(roots.where("node = root").select("node", "root", F.lit(0).alias("level"), F.col("node").alias("at")), "level")
    before, levels = now.limit(0), now
    depth = 0
    while True:
        depth += 1
        found = both.join(now.select(F.col("node").alias("x"), "root", "at"), "x").groupBy(F.col("y").alias("node")).agg(F.min("root").alias("root"), F.min("at").alias("parent"))
        new = found.join(now.select("node").union(before.select("node")), "node", "left_anti")
        following = in_runs(new.select("node", "root", F.lit(depth).alias("level"), "parent"), ["root", "parent", "node"], "at").drop("parent")
        if following.isEmpty():
            break
        levels, before, now = levels.union(following), now, following
        if depth % 16 == 0:  # so that a deep graph isn't a union of very many tables
            levels = cut(levels, "levels")
    return numbered(levels, ["root", "level", "at"]).drop("at")


def scan_plan(edges: DataFrame, order: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, b, level, parent) for every undirected edge: where it is taken into account.

    Shards are stretches of the order; they merge in pairs, the pairs in pairs, and so on. An edge
    inside a shard has level 0 and that shard as parent; another is kept at the lowest level at
    which its ends are in one region, and the number of that region.
    """
    of = order.select("node", F.expr(f"position DIV {shard}").alias("shard"))
    e = undirected(edges).join(of.withColumnsRenamed({"node": "a", "shard": "sa"}), "a").join(of.withColumnsRenamed({"node": "b", "shard": "sb"}), "b")
    apart = F.col("sa").bitwiseXOR(F.col("sb"))
    level = F.when(apart == 0, 0).otherwise(F.length(F.bin(apart)))  # halvings until they are one
    return e.withColumn("level", level).select("a", "b", "level", F.expr("shiftright(sa, level)").alias("parent"))


# -- inside a shard -----------------------------------------------------------


def local_moves(around: list[dict[int, float]], degree: np.ndarray, home: list[int], twice: float, within: list[int] | None = None) -> bool:
    """Moves each node to the neighbouring group that gains most, until none gains; whether any moved.

    within: groups that must not be left. Then only a node that is still alone moves, so that a
    group grows along edges and is never left by a node that holds it together.
    """
    weight = np.bincount(home, degree, minlength=len(home))
    size = np.bincount(home, minlength=len(home))
    todo, waiting, any_moved = deque(range(len(home))), [True] * len(home), False
    while todo:
        i = todo.popleft()
        waiting[i] = False
        old = home[i]
        if within is not None and size[old] > 1:
            continue
        links: dict[int, float] = {}
        for j, w in around[i].items():
            if within is None or within[j] == within[i]:
                links[home[j]] = links.get(home[j], 0.0) + w
        rest = weight[old] - degree[i]
        stay = links.get(old, 0.0) - rest * degree[i] / twice
        best, most = old, stay + 1e-9
        for c in sorted(links):
            gain = links[c] - weight[c] * degree[i] / twice
            if c != old and gain > most:
                best, most = c, gain
        if best == old:
            continue
        weight[old], weight[best] = rest, weight[best] + degree[i]
        size[old], size[best] = size[old] - 1, size[best] + 1
        home[i], any_moved = best, True
        for j in around[i]:
            if home[j] != best and not waiting[j]:
                waiting[j] = True
                todo.append(j)
    return any_moved


def _aggregate(around: list[dict[int, float]], degree: np.ndarray, groups: list[int]) -> tuple[list[dict[int, float]], np.ndarray, list[int]]:
    """The graph of groups, and for each node the number of its group."""
    names = {g: k for k, g in enumerate(dict.fromkeys(groups))}
    of = [names[g] for g in groups]
    out: list[dict[int, float]] = [{} for _ in names]
    for i, near in enumerate(around):
        for j, w in near.items():
            if of[i] != of[j]:
                out[of[i]][of[j]] = out[of[i]].get(of[j], 0.0) + w
    return out, np.bincount(of, degree), of


def leiden(around: list[dict[int, float]], degree: np.ndarray, twice: float) -> list[int]:
    """A group for each node of a graph that fits a task: moves, refinement, aggregation, again."""
    member = list(range(len(around)))  # of each node, its node in the present graph
    home = list(range(len(around)))
    while local_moves(around, degree, home, twice):
        refined = list(range(len(around)))
        local_moves(around, degree, refined, twice, within=home)
        if len(set(refined)) == len(refined):
            break
        around, degree, of = _aggregate(around, degree, refined)
        kept = {}
        for i, k in enumerate(of):
            kept[k] = home[i]
        names = {g: min(k for k in kept if kept[k] == g) for g in set(kept.values())}
        home = [names[kept[k]] for k in range(len(around))]
        member = [of[m] for m in member]
    return [home[m] for m in member]


def pieces(around: list[dict[int, float]], home: list[int]) -> list[int]:
    """home with every group that isn't connected cut into those of its parts that are."""
    out = [-1] * len(home)
    for s in range(len(home)):
        if out[s] < 0:
            out[s], todo = s, [s]
            while todo:
                i = todo.pop()
                for j in around[i]:
                    if out[j] < 0 and home[j] == home[i]:
                        out[j] = s
                        todo.append(j)
    return out


def _clustered(groups: DataFrame, edges: DataFrame, total: float) -> DataFrame:
    """(old, community): the groups (region, community, k) of each region clustered by the edges
    (region, a, b, w) between them. A community is connected and has the least name of its groups."""
    nodes = groups.select("region", F.col("community").alias("a"), F.lit(None).cast("long").alias("b"), F.col("k").alias("w"))

    def work(f: pd.DataFrame) -> pd.DataFrame:
        is_node = f.b.isna()
        nodes = f[is_node].sort_values("a")
        place = {int(x): i for i, x in enumerate(nodes.a)}
        around: list[dict[int, float]] = [{} for _ in place]
        for a, b, w in f.loc[~is_node, ["a", "b", "w"]].itertuples(index=False):
            i, j = place[int(a)], place[int(b)]
            around[i][j] = around[j][i] = w
        home = pieces(around, leiden(around, nodes.w.to_numpy(float), 2 * total))
        ids = nodes.a.to_numpy()
        return pd.DataFrame({"old": ids, "community": ids[home]})  # nodes are sorted: the first of a piece is its least

    return nodes.union(edges.select("region", "a", "b", "w")).groupBy("region").applyInPandas(work, "old long, community long")


def by_regions(edges: DataFrame, order: DataFrame, degree: DataFrame, total: float, shard: int = SHARD) -> DataFrame:
    """(node, community): shards clustered by their inner edges, then regions of two, of four and so on
    by what they found and the edges that a region is the first to have inside.

    A region in which more than `shard` groups are left is too large for a task: it and all that it
    would be part of are left to `merged`. Degrees are those of the whole graph.
    """
    place = order.select("node", F.expr(f"position DIV {shard}").alias("shard")).join(degree, "node", "left").select("node", "shard", F.coalesce("degree", F.lit(0.0)).alias("degree"))
    place = cut(place, "places")
    home = place.select("node", F.col("node").alias("community"))
    shards = (place.agg(F.max("shard")).first()[0] or 0) + 1
    for level in range((shards - 1).bit_length() + 1):
        groups = place.join(home, "node").groupBy("community").agg(F.sum("degree").alias("k"), F.min("shard").alias("shard")).withColumn("region", F.shiftright("shard", level))
        groups = cut(groups, "groups")
        fits = groups.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") <= shard).select("region")
        if level and fits.isEmpty():
            break
        regions = groups.join(fits, "region") if level else groups
        of = regions.select("community", "region")
        inner = _group_graph(edges, home).join(of.withColumnsRenamed({"community": "a"}), "a").join(of.withColumnsRenamed({"community": "b", "region": "other"}), "b").where("region = other")
        found = _clustered(regions, inner, total).withColumnRenamed("community", "new")
        home = cut(home.join(found, home["community"] == found["old"], "left").select("node", F.coalesce("new", "community").alias("community")), "home")
    return home


# -- over the whole graph -----------------------------------------------------


def _rank(c: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))


def _coin(c: str, turn: int) -> Column:
    return F.xxhash64(F.col(c), F.lit(turn)) % 2 == 0


def _group_graph(edges: DataFrame, home: DataFrame) -> DataFrame:
    """(a, b, w): the number of edges between each two communities."""
    to = home.select("node", "community")
    e = edges.join(to.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(to.withColumnsRenamed({"node": "b", "community": "cb"}), "b").where("ca <> cb")
    return e.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").cast("double").alias("w"))


def merged(edges: DataFrame, home: DataFrame, degree: DataFrame, total: float) -> DataFrame:
    """(node, community): communities merged while any two that are linked gain by it.

    Every merge raises modularity: those that join a centre in one turn are let in if each gains even
    when all others are in before it, and the one that gains most always is. Ranks are drawn anew each
    turn; of two that are best for each other one ranks higher, so that about half of all such pairs
    merge in a turn and turns grow with the logarithm.
    """
    graph = cut(_group_graph(edges, home), "groups")
    weight = cut(home.join(degree, "node", "left").groupBy("community").agg(F.sum(F.coalesce("degree", F.lit(0.0))).alias("k")), "weights")
    into = None
    for turn in range(MOST_ROUNDS):
        k = weight.withColumnsRenamed({"community": "x", "k": "kx"})
        both = graph.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").union(graph.select("b", "a", "w"))
        gains = both.join(k, "x").join(weight.withColumnsRenamed({"community": "y", "k": "ky"}), "y").withColumn("gain", F.col("w") - F.col("kx") * F.col("ky") / (2 * total)).where("gain > 1e-9")
        best = cut(gains.groupBy("x").agg(F.max_by(F.struct("y", "w", "kx", "ky", "gain"), F.struct(F.round("gain", 9), -F.col("y"))).alias("p")).select("x", "p.*"), "best")
        if best.isEmpty():
            break
        # a centre's own pick has a lower rank than it, so it asks nobody
        picks = best.select(F.col("x").alias("y"), F.col("y").alias("z"))
        asked = best.join(picks, "y").where((_rank("y", turn) > _rank("x", turn)) & (_rank("y", turn) > _rank("z", turn)))
        load = asked.groupBy("y").agg(F.sum("kx").alias("load"), F.max_by("x", F.struct("gain", -F.col("x"))).alias("first"))
        let_in = asked.join(load, "y").where((F.col("x") == F.col("first")) | (F.col("w") - F.col("kx") * (F.col("ky") + F.col("load") - F.col("kx")) / (2 * total) > 1e-9))
        moves = cut(let_in.select("x", F.col("y").alias("to")), "moves")
        if moves.isEmpty():
            continue
        now = lambda c: F.coalesce("to", F.col(c))
        far = lambda df, c: df.join(moves.withColumnRenamed("x", c), c, "left").withColumn(c, now(c)).drop("to")  # noqa: B023, E731
        graph = cut(far(far(graph, "a"), "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "groups")
        weight = cut(far(weight, "community").groupBy("community").agg(F.sum("k").alias("k")), "weights")
        into = cut(moves.withColumnRenamed("x", "community") if into is None else _followed(into, moves), "into")
    else:
        raise RuntimeError("communities did not settle")
    return _named(home.join(into, "community", "left").select("node", F.coalesce("to", "community").alias("community"))) if into is not None else home


def _followed(into: DataFrame, moves: DataFrame) -> DataFrame:
    """(community, to) of all merges so far, after more moves (x, to)."""
    more = moves.select(F.col("x").alias("to"), F.col("to").alias("further"))
    return into.join(more, "to", "left").select("community", F.coalesce("further", "to").alias("to")).union(moves.select(F.col("x").alias("community"), "to"))


def _named(home: DataFrame) -> DataFrame:
    """Communities by the name of their least node."""
    names = home.groupBy("community").agg(F.min("node").alias("least"))
    return cut(home.join(names, "community").select("node", F.col("least").alias("community")), "home")


def connected(edges: DataFrame, home: DataFrame) -> DataFrame:
    """(node, community): communities that aren't connected cut into those of their parts that are."""
    to = home.select("node", "community")
    inside = edges.join(to.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(to.withColumnsRenamed({"node": "b", "community": "cb"}), "b").where("ca = cb")
    return cut(home.select("node").join(components(inside.select("a", "b")), "node", "left").select("node", F.coalesce("root", "node").alias("community")), "home")


def moved_once(edges: DataFrame, home: DataFrame, degree: DataFrame, total: float, turn: int) -> DataFrame:
    """(node, community): nodes moved to the neighbouring community that gains most. A coin lets a
    community only lose or only take nodes in a turn, so that what a node counts on mostly holds."""
    to = home.join(degree, "node")
    weight = to.groupBy("community").agg(F.sum("degree").alias("k"))
    links = _both_ways(edges).join(home.select(F.col("node").alias("y"), F.col("community").alias("other")), "y").groupBy(F.col("x").alias("node"), "other").agg(F.count("*").cast("double").alias("w"))
    own = to.join(weight, "community").join(links.withColumnRenamed("other", "community"), ["node", "community"], "left").select("node", "community", "degree", (F.coalesce("w", F.lit(0.0)) - (F.col("k") - F.col("degree")) * F.col("degree") / (2 * total)).alias("stay"))
    leaving = own.where(~_coin("community", turn))
    offers = leaving.join(links, "node").where(_coin("other", turn)).join(weight.withColumnsRenamed({"community": "other", "k": "ko"}), "other")
    gains = offers.withColumn("gain", F.col("w") - F.col("ko") * F.col("degree") / (2 * total) - F.col("stay")).where("gain > 1e-9")
    best = gains.groupBy("node").agg(F.max_by("other", F.struct(F.round("gain", 9), -F.col("other"))).alias("other"))
    return cut(home.join(best, "node", "left").select("node", F.coalesce("other", "community").alias("community")), "moved")


def quality(edges: DataFrame, home: DataFrame, degree: DataFrame, total: float) -> float:
    """Modularity of a partition; one number goes to the driver."""
    if not total:
        return 0.0
    to = home.select("node", "community")
    inside = edges.join(to.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(to.withColumnsRenamed({"node": "b", "community": "cb"}), "b").where("ca = cb").count()
    spread = home.join(degree, "node").groupBy("community").agg(F.sum("degree").alias("k")).agg(F.sum(F.pow(F.col("k") / (2 * total), 2))).first()[0]
    return inside / total - (spread or 0.0)


def scan_and_merge(edges: DataFrame, alone: DataFrame | None = None, shard: int = SHARD, polish: int = 1) -> tuple[DataFrame, list[float]]:
    """((node, community), modularity after the regions, after merging, and after each polishing).

    Communities are connected, named by their least node, and cover all nodes of edges (a, b) and of
    alone (node); repeated edges and loops count for nothing. A polishing moves nodes, cuts what fell
    apart and merges again; it is kept if modularity has grown, so the list never falls.
    """
    edges = cut(undirected(edges), "edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    degree = cut(ends.groupBy("node").agg(F.count("*").cast("double").alias("degree")), "degree")
    total = float(edges.count())
    order = cut(scan_order(edges, alone), "order")
    if not total:
        return order.select("node", F.col("node").alias("community")), [0.0]
    home = by_regions(edges, order, degree, total, shard)
    grades = [quality(edges, home, degree, total)]
    home = merged(edges, home, degree, total)
    grades.append(quality(edges, home, degree, total))
    for turn in range(polish):
        other = merged(edges, connected(edges, moved_once(edges, home, degree, total, turn)), degree, total)
        grade = quality(edges, other, degree, total)
        if grade <= grades[-1]:
            break
        home = other
        grades.append(grade)
    return home, grades


def gains(edges: DataFrame, home: DataFrame) -> DataFrame:
    """(a, b, gain): what modularity would gain by merging two linked communities."""
    e = cut(undirected(edges), "edges")
    total = float(e.count())
    degree = _both_ways(e).groupBy(F.col("x").alias("node")).agg(F.count("*").cast("double").alias("degree"))
    weight = home.join(degree, "node").groupBy("community").agg(F.sum("degree").alias("k"))
    graph = _group_graph(e, home).join(weight.withColumnsRenamed({"community": "a", "k": "ka"}), "a").join(weight.withColumnsRenamed({"community": "b", "k": "kb"}), "b")
    return graph.select("a", "b", ((F.col("w") - F.col("ka") * F.col("kb") / (2 * total)) / total).alias("gain"))


def partition_report(edges: DataFrame, home: DataFrame) -> DataFrame:
    """One row (nodes, named_by_least, parts): nodes that have one community, communities named by their
    least node, and connected parts of communities. A good partition has as many parts as communities."""
    e = undirected(edges)
    one = home.groupBy("node").count().where("count = 1").agg(F.count("*").alias("nodes"))
    names = home.groupBy("community").agg(F.min("node").alias("least")).agg(F.count(F.when(F.col("least") == F.col("community"), 1)).alias("named_by_least"))
    parts = connected(e, home).agg(F.count_distinct("community").alias("parts"))
    return one.join(names).join(parts)  # one row each
