"""Candidate pairs of statements by ranked lanes and reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dream_tokens, reciprocal_rank
from ..session import cut
from .blocks import all_pairs, jaccards

#: Weights of the lanes, and how many candidates are kept, of which so many places are for the prior lane.
WEIGHTS = {"semantic": 1.0, "prior": 0.6, "lexical": 0.35, "temporal": 1.0}
KEPT, PRIOR_QUOTA = 12, 3
#: What an equal category or type adds to a lexical score.
BOOSTS = {("category", "other_category"): 0.08, ("type", "other_type"): 0.08}
#: Candidates that a lane brings for a source. A rank of this or more adds at most 1/(60 + DEPTH).
DEPTH = 256


def canonical(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(a, b): distinct unordered pairs, the smaller first."""
    return pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a <> b").distinct()


def excluded(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (source, candidate, ...) that aren't among known unordered pairs (a, b)."""
    keyed = pairs.withColumn("a", F.least("source", "candidate")).withColumn("b", F.greatest("source", "candidate"))
    return keyed.join(known, ["a", "b"], "left_anti").drop("a", "b")


def tokenized(texts: DataFrame, *more: str) -> DataFrame:
    """(id, tokens, more...) of statements (id, text, ...) that have tokens, written: blocks read it again and again."""
    return cut(texts.select("id", dream_tokens(F.col("text")).alias("tokens"), *more).where(F.size("tokens") > 0), "tokens")


def token_overlap(left: DataFrame, right: DataFrame, digits: int | None = None) -> DataFrame:
    """(source, candidate, jaccard) of all statements (id, text) of left, a stated batch, with those of
    right that share a token, however common it is. Tokens in common are counted block by block, so that
    pairs are rows only in the result; digits: of the result, halves up."""
    rows, sources = (tokenized(df).withColumnRenamed("id", name) for df, name in ((right, "candidate"), (left, "source")))
    return all_pairs(rows, sources, jaccards("tokens", "tokens", digits=digits)).withColumnRenamed("score", "jaccard")


def lexical_boost(pairs: DataFrame) -> DataFrame:
    """pairs with lexical: jaccard, and more for an equal category, type, or parent that is known."""
    same = lambda a, b, w: F.when(F.col(a) == F.col(b), w).otherwise(0.0)
    return pairs.withColumn("lexical", F.col("jaccard") + same("category", "other_category", BOOSTS["category", "other_category"]) + same("type", "other_type", BOOSTS["type", "other_type"]) + same("parent", "other_parent", 0.12))


def ranked_lanes(lanes: dict[str, DataFrame], depth: int = DEPTH) -> DataFrame:
    """(source, candidate, <lane>_rank...) of the lanes' own scores (source, candidate, score): ranks
    from 1, higher scores first, ties by candidate. Each lane brings its best `depth` candidates of a
    source, whatever the other lanes know of them; a candidate without a rank there has null."""
    order = Window.partitionBy("source").orderBy(F.desc("score"), "candidate")
    parts = [df.where("score is not null").select("source", "candidate", F.lit(name).alias("lane"), F.row_number().over(order).alias("r")).where(F.col("r") <= depth) for name, df in lanes.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.groupBy("source", "candidate").agg(*(F.max(F.when(F.col("lane") == name, F.col("r"))).alias(f"{name}_rank") for name in lanes))


def fused_candidates(lanes: dict[str, DataFrame], kept: int = KEPT, quota: int = PRIOR_QUOTA, depth: int = DEPTH) -> DataFrame:
    """(source, candidate, fused, place): at most kept candidates a source by weighted reciprocal ranks,
    with quota places for the best of the prior lane; ties by candidate."""
    score = sum((reciprocal_rank(F.col(f"{lane}_rank"), WEIGHTS[lane]) for lane in lanes), F.lit(0.0))
    fused = ranked_lanes(lanes, depth).withColumn("fused", F.round(score, 12))
    reserved = F.col("prior_rank") <= quota if "prior" in lanes else F.lit(False)
    first = Window.partitionBy("source").orderBy(F.desc(F.coalesce(reserved, F.lit(False))), F.desc("fused"), "candidate")
    chosen = fused.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= kept)
    order = Window.partitionBy("source").orderBy(F.desc("fused"), "candidate")
    return chosen.select("source", "candidate", "fused", F.row_number().over(order).alias("place"))


def verdict(answers: DataFrame, questions: list[str]) -> DataFrame:
    """answers with verdict: any `no` rejects, else any `uncertain` is uncertain, else accept."""
    got = F.array(*questions)
    return answers.withColumn("verdict", F.when(F.array_contains(got, "no"), "reject").when(F.array_contains(got, "uncertain"), "uncertain").otherwise("accept"))
