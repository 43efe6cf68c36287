"""Operator 13: how filters act on each other, whichever order they are applied in.

Every order of the filters is a path through the lattice of subsets: its steps are edges from the
set of filters applied so far to that set and one more. What a step keeps and removes depends on its
edge alone, so 80 edges hold all that the 600 steps of 120 orders report. Documents are summed to
the set of filters that they fail (in each task first), these sums to edges, and the edges are
joined to the steps of all paths.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, written

FILTERS = "ABCDE"
#: Fewest words; fewest distinct words and most capital letters in a hundred.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails each of the filters that need no other text: too few words, too few
    distinct words, too many capitals, a symbol of [#$%&*|]."""
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, _CAPITALS, ""))
    return [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long"),
        100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) for every row: bit k of mask is set where it fails the k-th filter.

    Null text and null part are empty. The last filter fails a row whose text a smaller id has too,
    in any part; a null id is neither smaller nor larger than any. Texts are compared by SHA-256.
    Narrow rows are written first; of texts, only those with copies are joined, and a text that very
    many rows share is a large key of the wide side alone, which adaptive execution splits.
    """
    text = text_or_empty(text_col)
    mask = sum((failed.cast("int") * (1 << k) for k, failed in enumerate(text_failures(text))), F.lit(0))
    rows = written(docs.select(F.col(id_col).alias("id"), text_or_empty(part_col).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")), "failures")
    copies = written(rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last")).drop("last"), "copies")
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return rows.join(copies, "digest", "left").select("id", "part", (F.col("mask") + later.cast("int") * (1 << 4)).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows by what they fail. labels (doc_id, quality, toxic) may
    repeat an id, which is good or toxic if any of its rows says so, and may lack it."""
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    rows = failed.join(told, failed["id"] == told["doc_id"], "left")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_good").alias("good"), F.count_if("is_toxic").alias("toxic"))


def on_edges(rows: DataFrame) -> DataFrame:
    """Each row on all 80 edges: (applied, bit), and orders, the number of orders that the edge is in."""
    out = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("applied"))
    out = out.select("*", F.explode(F.array(*(F.lit(1 << k) for k in range(5)))).alias("bit")).where(F.col("applied").bitwiseAND(F.col("bit")) == 0)
    done = F.bit_count("applied")
    return out.withColumn("orders", F.factorial(done) * F.factorial(4 - done))


def paths(spark: SparkSession) -> DataFrame:
    """(filter_order, step, applied, bit): the 600 steps of all orders as edges of the lattice."""
    steps = []
    for order in permutations(range(5)):
        applied = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[x] for x in order), k + 1, applied, 1 << f))
            applied |= 1 << f
    return spark.createDataFrame(steps, "filter_order string, step int, applied int, bit int")


def edge_counts(counts: DataFrame) -> DataFrame:
    """(part, applied, bit, orders, kept, ...): what happens to a part's rows on each edge, zeros
    included. counts has at most 32 rows of a part."""
    reached, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    sums = {
        "kept": ("n", reached & ~fails),
        "removed": ("n", reached & fails),
        "redundant": ("n", ~reached & fails),
        "unique_fails": ("n", F.col("mask") == F.col("bit")),
        "good_lost": ("good", reached & fails),
        "toxic_lost": ("toxic", reached & fails),
    }
    return on_edges(counts).groupBy("part", "applied", "bit", "orders").agg(*(F.sum(F.when(where, F.col(n)).otherwise(0)).alias(name) for name, (n, where) in sums.items()))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley): 600 rows for each part that docs have; none for an empty table. shapley sums what the
    step's filter removes over all orders: each edge counts as often as it is on a path."""
    counts = written(mask_counts(failures(docs), labels), "mask-counts")
    edges = edge_counts(counts)
    value = edges.groupBy("part", "bit").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    steps = F.broadcast(paths(docs.sparkSession))  # 600 rows
    return edges.join(value, ["part", "bit"]).join(steps, ["applied", "bit"]).select("part", "filter_order", "step", *_COUNTS, "shapley")
