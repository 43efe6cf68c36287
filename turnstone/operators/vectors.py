"""Exact vector search, fusion with lexical hits, dedup and diversification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, fused, norm, normalised_weights, valid
from ..session import cut


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", positive: bool = True) -> DataFrame:
    """(query_id, id, score, rank): each query's k nearest vectors, ties by id.

    queries: (query_id, query) of a stated batch, small enough to be broadcast (callers pass a
    bounded batch); vectors are scanned once. positive: scores of 0 and less are left out.
    """
    good = vectors.where(valid(F.col("vector"))).select(id_col, "vector")
    scores = good.crossJoin(F.broadcast(queries)).select("query_id", id_col, cosine(F.col("vector"), F.col("query")).alias("score")).where("score is not null")
    if positive:
        scores = scores.where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(lexical: DataFrame, semantic: DataFrame, key: list[str], k: int, weights: tuple[float, float] = (0.45, 0.55)) -> DataFrame:
    """(query_id, key..., score, rank) of lexical and semantic hits (query_id, key..., score) together, by
    weights in the ratio given."""
    on = ["query_id", *key]
    both = lexical.withColumnRenamed("score", "lex").join(semantic.withColumnRenamed("score", "sem"), on, "full_outer")
    scores = both.select(*on, fused(F.col("lex"), F.col("sem"), *normalised_weights(*weights)).alias("score"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *key))).where(F.col("rank") <= k)


def deduplicated(hits: DataFrame, same: list[str], key: str) -> DataFrame:
    """The best hit of each query and range."""
    order = Window.partitionBy("query_id", *same).orderBy(F.desc("score"), key)
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def diversified(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, pick): greedily, each pick lowers what is left of its conversation by the
    share of positions that it overlaps. hits: at most some tens a query, (query_id, id,
    conversation_id, start, end, score)."""

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        score, left, out = dict(zip(f.id, f.score, strict=True)), {r.id: r for r in f.itertuples()}, []
        while left and len(out) < k:
            best = min(left.values(), key=lambda r: (-score[r.id], r.id))
            out.append((best.query_id, best.id, float(score[best.id]), len(out) + 1))
            del left[best.id]
            for r in left.values():
                if r.conversation_id == best.conversation_id:
                    common = max(0, min(r.end, best.end) - max(r.start, best.start))
                    score[r.id] *= 1 - common / max(1, min(r.end - r.start, best.end - best.start))
        return pd.DataFrame(out, columns=["query_id", "id", "score", "pick"])

    kinds = dict(hits.dtypes)
    return hits.select("query_id", "id", "conversation_id", "start", "end", "score").groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, pick int")


def missing(items: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """Items that have no vector yet."""
    return items.join(vectors, key, "left_anti")


def mean_vectors(vectors: DataFrame, group: str) -> DataFrame:
    """(group, position, mean): the mean of each component."""
    parts = vectors.select(group, F.posexplode("vector").alias("position", "x"))
    return parts.groupBy(group, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def medoids(vectors: DataFrame, group: str, id_col: str) -> DataFrame:
    """(group, id, score): the vector with the largest sum of cosines with its group, ties by id.

    The sum of a unit vector's dot products is its dot product with the sum of unit vectors, so each
    group is added up once and no pairs are made.
    """
    size = norm(F.col("vector"))
    unit = vectors.where(valid(F.col("vector"))).select(group, id_col, F.transform("vector", lambda x: x.cast("double") / size).alias("unit"))
    sums = unit.select(group, F.posexplode("unit").alias("p", "x")).groupBy(group, "p").agg(F.sum("x").alias("x"))
    total = sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("total"))
    dots = F.aggregate(F.zip_with("unit", "total", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scores = unit.join(total, group).select(group, id_col, F.round(dots, 9).alias("score"))
    return scores.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), id_col))).where("_n = 1").drop("_n")


def is_normalised(vector: Column, within: float = 1e-4) -> Column:
    """Whether a valid vector has length 1, about."""
    return F.coalesce(valid(vector) & (F.abs(norm(vector) - 1) <= within), F.lit(False))


def diverse(vectors: DataFrame, group: str, id_col: str, count: int) -> DataFrame:
    """(group, id, place): the medoid of each group, then `count - 1` times what is farthest from all that
    were picked (the least of the largest cosines, to nine places, ties by id). A pick is an aggregate;
    what it joins is a row a group."""
    good = cut(vectors.where(valid(F.col("vector"))).select(group, F.col(id_col).alias("_id"), "vector"), "vectors")
    picks = cut(medoids(good, group, "_id").join(good, [group, "_id"]).select(group, F.array("_id").alias("ids"), F.array("vector").alias("picked")), "picks")
    for _ in range(1, count):
        near = F.array_max(F.transform("picked", lambda p: F.round(cosine(F.col("vector"), p), 9)))
        rest = good.join(picks, group).where(~F.array_contains("ids", F.col("_id")))
        far = rest.groupBy(group).agg(F.min_by(F.struct("_id", "vector"), F.struct(near, "_id")).alias("_far"))
        grown = picks.join(far, group, "left")
        more = lambda c, x: F.when(F.col("_far").isNull(), F.col(c)).otherwise(F.array_append(c, F.col(f"_far.{x}"))).alias(c)
        picks = cut(grown.select(group, more("ids", "_id"), more("picked", "vector")), "picks")
    return picks.select(group, F.posexplode("ids").alias("place", id_col)).select(group, id_col, "place")


def probe_min(profile: DataFrame, probe: DataFrame, key: str) -> DataFrame:
    """One row (least, compatible): the least cosine of stored and fresh probes; 0.9998 is asked for."""
    both = profile.withColumnRenamed("vector", "a").join(probe.withColumnRenamed("vector", "b"), key)
    least = both.agg(F.min(cosine(F.col("a"), F.col("b"))).alias("least"))
    return least.select("least", (F.col("least") + 1e-12 >= 0.9998).alias("compatible"))
