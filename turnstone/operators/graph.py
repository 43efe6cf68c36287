"""A typed graph kept as a log of edge mutations: state, neighbours, paths, changes, components.

Mutations are (version, source, target, kind, active, origin). An edge is (source, target, kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .timeline import latest

EDGE = ["source", "target", "kind"]
#: Rounds after which something must be wrong: ways to a root about halve in each.
MOST_ROUNDS = 64


def current_relations(log: DataFrame) -> DataFrame:
    """Edges whose last mutation is active."""
    return latest(log, EDGE, "version").where("active")


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str) -> DataFrame:
    """(node, neighbor, kind) of the asked nodes (node), `out` or `in`."""
    near, far = ("source", "target") if direction == "out" else ("target", "source")
    return edges.select(F.col(near).alias("node"), F.col(far).alias("neighbor"), "kind").join(nodes, "node", "left_semi")


def structural_edges(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, whatever kinds and directions there are."""
    return edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, degree) of undirected pairs (a, b)."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def distances(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, depth): the fewest directed steps from each start to each node, at most `most`.

    A level at a time: only nodes that the last level reached first are joined with the edges.
    """
    step = cut(edges.select(F.col("source").alias("node"), F.col("target").alias("next")).distinct(), "steps")
    seen = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")), "level")
    level = seen
    for depth in range(1, most + 1):
        reached = level.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        level = cut(reached.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen


def edge_changes(current: DataFrame, wanted: DataFrame, keep_origin: str | None = None) -> DataFrame:
    """(source, target, kind, active): what to append so that the current edges become the wanted.

    Edges of keep_origin are never taken away, nor is an edge of that origin set again.
    """
    held = current.where(F.col("origin") != keep_origin) if keep_origin else current
    off = held.join(wanted, EDGE, "left_anti").select(*EDGE, F.lit(False).alias("active"))
    on = wanted.join(current, EDGE, "left_anti").select(*EDGE, F.lit(True).alias("active"))
    return on.union(off)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of pairs (a, b).

    In a round every node's pointer becomes the least pointer around it, and then the pointer of its
    pointer; ways halve, so the rounds are few. Minima are aggregated per task before they meet.
    """
    rounds = 0
    both = cut(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct(), "pairs")
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
    while (rounds := rounds + 1) <= MOST_ROUNDS:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = state.join(near, "node").select("node", F.least("root", "near").alias("low"), "root")
        # a root that is told of a lower one follows it, and all that point to it do
        hooks = lower.groupBy("root").agg(F.min("low").alias("hook")).withColumnRenamed("root", "r")
        new = cut(lower.join(hooks, lower["low"] == hooks["r"], "left").select("node", F.least("low", F.coalesce("hook", "low")).alias("root"), F.col("root").alias("old")), "roots")
        state = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return state
    raise RuntimeError("components did not settle")


def expansion(edges: DataFrame, seeds: DataFrame, communities: DataFrame, budget: int = 32, depth: int = 3) -> DataFrame:
    """(query_id, node, depth, boundaries, place): best-first from seeds (query_id, node, place).

    Nodes come by (depth, communities crossed, order found); at most budget nodes and depth steps.
    The neighbourhood of depth steps is collected by joins, then each query's walk is one function
    call over edges among at most some thousands of nodes.
    """
    import pandas as pd

    both = edges.select(F.col("source").alias("x"), F.col("target").alias("y")).union(edges.select(F.col("target").alias("x"), F.col("source").alias("y"))).where("x <> y").distinct()
    homes = communities.select(F.col("node").alias("y"), F.col("community").alias("home"))
    out = cut(both.join(homes, "y", "left").groupBy("x").agg(F.array_sort(F.collect_list(F.struct("y", "home"))).alias("next")), "adjacency")
    level = seeds.select("query_id", F.col("node").alias("x")).distinct()
    near = level
    for _ in range(depth - 1):
        level = level.join(out, "x").select("query_id", F.explode("next.y").alias("x")).distinct()
        near = near.union(level)
    lists = near.distinct().join(out, "x").select("query_id", F.col("x").alias("node"), "next", F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("home"))
    first = seeds.join(communities, "node", "left").select("query_id", "node", F.lit(None).cast(lists.schema["next"].dataType).alias("next"), F.col("place").cast("int").alias("place"), F.col("community").cast("int").alias("home"))
    kind = dict(seeds.dtypes)

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        import heapq

        begin = f[f.place.notna()].sort_values(["place", "node"])
        follow = {r.node: r.next for r in f[f.place.isna()].itertuples()}
        home = {r.node: None if pd.isna(r.home) else int(r.home) for r in begin.itertuples()}
        best: dict[int, tuple[int, int]] = {}
        queue: list[tuple[int, int, int, int]] = []
        turn = 0
        for r in begin.itertuples():
            if r.node not in best:
                best[r.node] = (0, 0)
                heapq.heappush(queue, (0, 0, turn, r.node))
                turn += 1
        rows, done = [], set()
        while queue and len(rows) < budget:
            d, crossed, _, node = heapq.heappop(queue)
            if node in done or best[node] != (crossed, d):
                continue
            done.add(node)
            rows.append((f.query_id.iloc[0], node, d, crossed, len(rows) + 1))
            if d == depth:
                continue
            for n in follow.get(node, ()):
                other, there = n["y"], None if n["home"] is None or pd.isna(n["home"]) else int(n["home"])
                home.setdefault(other, there)
                way = (crossed + (home[node] is None or there is None or home[node] != there), d + 1)
                if other not in done and (other not in best or way < best[other]):
                    best[other] = way
                    heapq.heappush(queue, (d + 1, way[0], turn, other))
                    turn += 1
        return pd.DataFrame(rows, columns=["query_id", "node", "depth", "boundaries", "place"])

    return lists.union(first).groupBy("query_id").applyInPandas(walk, f"query_id {kind['query_id']}, node {kind['node']}, depth int, boundaries int, place int")


def ranked_state(log: DataFrame) -> DataFrame:
    """Each edge's states in order: (source, target, kind, states)."""
    states = F.collect_list(F.struct("version", "active"))
    return log.groupBy(*EDGE).agg(F.transform(F.array_sort(states), lambda s: s["active"]).alias("states"))


def with_previous(log: DataFrame) -> DataFrame:
    """The log with whether a mutation changes its edge: a new edge only counts when active."""
    before = F.lag("active", 1, False).over(Window.partitionBy(*EDGE).orderBy("version"))
    return log.withColumn("changes", F.col("active") != before)


def set_relations(log: DataFrame, wanted: DataFrame, expected_version: int, version: int) -> DataFrame:
    """wanted (source, target, kind, active, origin) with outcome: `stale` (all, if the graph has moved on
    from the expected version), `repeated` (an edge twice in the batch), `equal` (state and origin are so
    already), `absent` (an unknown edge that is to be off) or `set`."""
    now = log.groupBy(*EDGE).agg(F.max_by(F.struct("active", "origin"), "version").alias("_now"))
    counts = wanted.groupBy(*EDGE).agg(F.count("*").alias("_n"))
    judged = wanted.join(counts, EDGE).join(now, EDGE, "left")
    outcome = (
        F.when(F.lit(expected_version != version), "stale")
        .when(F.col("_n") > 1, "repeated")
        .when(F.col("_now").isNull() & ~F.col("active"), "absent")
        .when((F.col("_now.active") == F.col("active")) & (F.col("_now.origin") == F.col("origin")), "equal")
        .otherwise("set")
    )
    return judged.select(*wanted.columns, outcome.alias("outcome"))
