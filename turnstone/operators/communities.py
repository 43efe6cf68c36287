"""Communities of a graph: quality, ids, lineage, routing. `clustering` finds them.

Lineage compares two generations by an equi-join on members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, dot, norm, valid
from ..session import cut

def modularity(edges: DataFrame, home: DataFrame) -> DataFrame:
    """One row (modularity, communities, edges) of undirected distinct edges (a, b)."""
    to = home.select("node", "community")
    e = edges.join(to.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(to.withColumnsRenamed({"node": "b", "community": "cb"}), "b")
    ends = e.select(F.col("ca").alias("c"), (F.col("ca") == F.col("cb")).cast("int").alias("i")).union(e.select(F.col("cb"), F.lit(0)))
    parts = ends.groupBy("c").agg(F.sum("i").alias("inside"), F.count("*").alias("degree"))
    m = parts.agg((F.sum("degree") / 2).alias("m"))
    q = parts.crossJoin(F.broadcast(m)).agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2))).alias("modularity"), F.count("*").alias("communities"), F.first("m").alias("edges"))  # m: one row
    return q


def community_ids(home: DataFrame, owner: str) -> DataFrame:
    """(community, id, members): id hashes the owner and the sorted members."""
    listed = F.array_join(F.array_sort(F.collect_list("node")), ",")
    return home.groupBy("community").agg(F.sha2(F.concat(F.lit(owner + ":"), listed), 256).alias("id"), F.count("*").alias("members"))


def overlaps(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old, new, common, jaccard): communities (community, node) of two generations that share members;
    jaccard in whole thousandths."""
    sizes = lambda df, name: df.groupBy(F.col("community").alias(name)).agg(F.count("*").alias(f"{name}_size"))
    both = before.withColumnRenamed("community", "old").join(after.withColumnRenamed("community", "new"), "node").groupBy("old", "new").agg(F.count("*").alias("common"))
    all_of = both.join(sizes(before, "old"), "old").join(sizes(after, "new"), "new")
    return all_of.select("old", "new", "common", F.expr("common * 1000 div (old_size + new_size - common)").alias("jaccard"))


def lineage(before: DataFrame, after: DataFrame) -> DataFrame:
    """overlaps with split (old has several), merge (new has several) and continuation (each is the
    other's only best)."""
    o = overlaps(before, after)
    count = lambda key: F.count("*").over(Window.partitionBy(key))
    top = lambda key: F.rank().over(Window.partitionBy(key).orderBy(F.desc("jaccard")))
    ranked = o.withColumns({"split": count("old") > 1, "merge": count("new") > 1, "ro": top("old"), "rn": top("new")})
    only = lambda key, r: F.sum(F.when(F.col(r) == 1, 1).otherwise(0)).over(Window.partitionBy(key)) == 1
    return ranked.withColumn("continuation", (F.col("ro") == 1) & (F.col("rn") == 1) & only("old", "ro") & only("new", "rn")).drop("ro", "rn")


def new_and_ended(before: DataFrame, after: DataFrame) -> DataFrame:
    """(community, state): those without a member in the other generation."""
    fresh = after.join(before.select("node"), "node", "left").join(overlaps(before, after).select(F.col("new").alias("community")).distinct(), "community", "left_anti")
    gone = before.join(overlaps(before, after).select(F.col("old").alias("community")).distinct(), "community", "left_anti")
    return fresh.select("community", F.lit("new").alias("state")).distinct().union(gone.select("community", F.lit("ended").alias("state")).distinct())


def _unit(v: Column) -> Column:
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _means(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., mean) of rows (by..., vector): summed up in each task first, component by component."""
    parts = rows.select(*by, F.posexplode("vector").alias("_p", "_x")).groupBy(*by, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("mean"))


def sub_centroids(vectors: DataFrame, count: int = 2, rounds: int = 2) -> DataFrame:
    """(community, place, centroid) of (community, id, vector): the vector nearest the mean, then
    farthest first, then rounds of moving under cosine. The last of equal maxima, the first of equal
    minima wins (cosines to nine places). Every step is an aggregate, whatever a community's size; what
    each round joins is `count` centres a community.
    """
    rows = cut(vectors.where(valid(F.col("vector"))).select("community", "id", "vector", _unit(F.col("vector")).alias("_u")), "vectors")
    near = lambda c: F.round(dot(F.col("_u"), c), 9)
    mean = _means(rows.select("community", "vector"), ["community"]).select("community", _unit(F.col("mean")).alias("_c"))
    first = rows.join(mean, "community").groupBy("community").agg(F.max_by("_u", F.struct(near(F.col("_c")), "id")).alias("_c"))
    centres = cut(first.select("community", F.array("_c").alias("centres")), "centres")
    for _ in range(1, count):
        far = F.array_max(F.transform("centres", lambda c: F.round(dot(F.col("_u"), c), 9)))
        pick = rows.join(centres, "community").groupBy("community").agg(F.min_by("_u", F.struct(far, "id")).alias("_new"), F.count("*").alias("_n"))
        grown = centres.join(pick, "community")  # a community of fewer vectors has fewer centres
        centres = cut(grown.select("community", F.when(F.size("centres") < F.col("_n"), F.array_append("centres", F.col("_new"))).otherwise(F.col("centres")).alias("centres")), "centres")
    for _ in range(rounds):
        scored = F.transform("centres", lambda c, i: F.struct(F.round(dot(F.col("_u"), c), 9).alias("s"), i.alias("place")))
        own = rows.join(centres, "community").select("community", "vector", F.array_max(scored)["place"].alias("place"))
        moved = _means(own, ["community", "place"]).select("community", "place", _unit(F.col("mean")).alias("_c"))
        kept = centres.select("community", F.posexplode("centres").alias("place", "_old")).join(moved, ["community", "place"], "left")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("_c", "_old").alias("c")))), lambda x: x["c"])
        centres = cut(kept.groupBy("community").agg(listed.alias("centres")), "centres")
    return centres.select("community", F.posexplode("centres").alias("place", "centroid"))


def routed(centroids: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, community, score, rank): the k communities with the nearest centroid (broadcast
    queries: a stated, bounded batch)."""
    scores = centroids.crossJoin(F.broadcast(queries)).groupBy("query_id", "community").agg(F.round(F.max(cosine(F.col("centroid"), F.col("query"))), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "community")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def admitted(items: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, id): items (id, community) of selected communities, and all without a community."""
    inside = items.join(selected.select("query_id", "community"), "community").select("query_id", "id")
    rest = items.where("community is null").select("id").crossJoin(F.broadcast(selected.select("query_id").distinct()))  # a bounded batch of queries
    return inside.union(rest.select("query_id", "id"))
