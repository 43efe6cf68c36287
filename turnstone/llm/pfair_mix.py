"""Operator 4: mixing sources to target weights by Pfair scheduling.

A source's documents are dealt into blocks. In an even flow each source gets its weight's share of
every slot until it is used up; the others then share by their weights. A block is released at the
slot in which the flow begins it and due when the flow ends it, in exact arithmetic on the weights as
given; in each slot the released block with the earliest deadline is taken. So after every slot each
source has had what its weight asks for, give or take less than one block, from the first slot to
the last. Every document gets one place. Sources of weight 0 come last, evenly.

Earliest deadline first is a sequential rule: the slots are worked out one after another in one
streamed task, which sees blocks, never documents, and holds a few numbers for each source. There
are at most MOST_BLOCKS of them (and one more a source): of more documents than that allows, a
block takes more than BLOCK_DOCS.

A document's rank in its source comes from (source, hash bucket, id): a source has a bucket for each
BUCKET_DOCS documents, ranks inside a bucket come from a window, the rest from adding up the buckets
before it, so that a source with a third of all documents is ranked in many tasks. Buckets are by id
and text, so that very many rows without an id, or with one, are dealt out too.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix, written

#: Documents of a block, the most blocks of a schedule, documents of a hash bucket.
BLOCK_DOCS, MOST_BLOCKS, BUCKET_DOCS = 16, 4_000_000, 2_048


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if exact and (sum(exact.values()) <= 0 or min(exact.values()) < 0):
        raise ValueError("weights must be positive")
    whole = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * whole) for s, w in exact.items()}


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """(source, block) of each slot, for sources with that many blocks."""
    weights = whole_weights({s: weights[s] for s, n in blocks.items() if n > 0})
    yield from _by_deadline(blocks, {s: w for s, w in weights.items() if w})
    yield from _by_deadline(blocks, {s: 1 for s, w in weights.items() if not w})


class _Flow:
    """When an even flow by weights has given a source its first k blocks."""

    def __init__(self, blocks: dict[str, int], weights: dict[str, int]):
        self.weights = weights
        self.ends = sorted(Fraction(blocks[s], w) for s, w in weights.items())  # of sources, on the flow's own clock
        # slots used by the first i sources that end, and the weights of the others
        self.used, self.active = [0], [sum(weights.values())]
        for s in sorted(weights, key=lambda s: Fraction(blocks[s], weights[s])):
            self.used.append(self.used[-1] + blocks[s])
            self.active.append(self.active[-1] - weights[s])
        self.passed = dict.fromkeys(weights, 0)

    def __call__(self, s: str, k: int) -> int:
        """The time of block k's begin, times the weight of s. k doesn't fall from call to call."""
        i, w = self.passed[s], self.weights[s]
        if i < len(self.ends) and self.ends[i].numerator * w <= k * self.ends[i].denominator:
            i = self.passed[s] = bisect_right(self.ends, Fraction(k, w), lo=i)
        return self.used[i] * w + self.active[i] * k


def _by_deadline(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int]]:
    flow = _Flow(blocks, weights)
    later = [(0, s, 0) for s in weights]  # release, source, block
    heapq.heapify(later)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    for t in range(flow.used[-1]):
        while later and later[0][0] <= t:
            _, s, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-flow(s, k + 1) // weights[s]), s, k))
        _, s, k = heapq.heappop(ready)
        yield s, k
        if k + 1 < blocks[s]:
            heapq.heappush(later, (flow(s, k + 1) // weights[s], s, k + 1))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", prefix: str = "mix_") -> DataFrame:
    """All rows and columns of docs with mix_block, mix_slot and mix_position (longs, from 0).

    weights: of each source; None: the square root of its number of documents. A null source counts
    as the source ''. Sources that weights doesn't name are an error. Buckets are
    dealt by id and a hash of the text, and ordered by these inside, null ids first. An empty table gives an
    empty result. prefix begins the three names; columns of docs that have one of them are replaced.
    block_docs: documents of a block, more if the schedule would have over MOST_BLOCKS blocks. The
    driver gets a count for each source; the schedule is a table in the shared folder, joined by
    block.
    """
    spark = docs.sparkSession
    made = [f"{prefix}{x}" for x in ("block", "slot", "position")]
    names, p = [c for c in docs.columns if c not in made], free_prefix(docs)  # p: before names of its own
    at = lambda name: F.col(p + name)
    # the text's hash comes first, so that a text that isn't asked for isn't shuffled
    rows = docs.select(*names, F.coalesce(F.col(source_col), F.lit("")).alias(p + "source"), F.xxhash64(text_col).alias(p + "hash"))
    total = dict(sorted(tuple(r) for r in rows.groupBy(p + "source").count().collect()))
    size = max(block_docs, -(-sum(total.values()) // MOST_BLOCKS))
    weights = {s: n**0.5 for s, n in total.items()} if weights is None else weights
    if missing := sorted(set(total) - set(weights)):
        raise ValueError(f"no weight for {missing[:5]}")
    weights = {x: weights[x] for x in total}
    whole_weights(weights)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = [p + x for x in ("source", "block", "slot", "begin")]
        for batch in batches:
            if not batch.num_rows:
                continue
            held, begin = [], 0
            for t, (x, k) in enumerate(schedule({x: -(-n // size) for x, n in total.items()}, weights)):
                held.append((x, k, t, begin))
                begin += min(size, total[x] - k * size)  # a source's last block may be short
                if len(held) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], form)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], form)

    plan = written(spark.range(0, 1, 1, 1).mapInArrow(slots, f"{p}source string, {p}block long, {p}slot long, {p}begin long"), "schedule")
    # written, so that Spark knows its size: no source's rows are brought together to meet a small table
    buckets = written(spark.createDataFrame([(s, -(-n // BUCKET_DOCS)) for s, n in total.items()], f"{p}source string, {p}buckets long").coalesce(1), "buckets")
    dealt = rows.join(buckets, p + "source").withColumn(p + "bucket", F.pmod(F.xxhash64(id_col, p + "hash"), at("buckets"))).drop(p + "buckets")
    before = Window.partitionBy(p + "source").orderBy(p + "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(p + "source", p + "bucket").agg(F.count("*").alias(p + "n"))
    offsets = written(offsets.select(p + "source", p + "bucket", F.coalesce(F.sum(p + "n").over(before), F.lit(0)).alias(p + "before")), "offsets")
    order = Window.partitionBy(p + "source", p + "bucket").orderBy(F.col(id_col).asc_nulls_first(), p + "hash")
    ranked = (
        dealt.withColumn(p + "n", F.row_number().over(order))
        .join(offsets, [p + "source", p + "bucket"])
        .withColumn(p + "rank", at("before") + at("n") - 1)
        .withColumn(p + "block", F.expr(f"{p}rank div {size}"))
    )
    placed = ranked.join(plan, [p + "source", p + "block"])
    position = at("begin") + at("rank") % size
    return placed.select(*names, at("block").alias(made[0]), at("slot").alias(made[1]), position.alias(made[2]))


def in_mixed_order(mixed: DataFrame, count: int, parts: int, prefix: str = "mix_") -> DataFrame:
    """Rows of mix_sources dealt to parts by position, each in order: written files follow the mix."""
    at = F.expr(f"cast({prefix}position * {parts} div {max(1, count)} as int)")
    return mixed.repartitionById(parts, at).sortWithinPartitions(f"{prefix}position")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mix_block, mix_slot, mix_position) of every document."""
    return mix_sources(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")
