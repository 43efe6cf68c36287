"""Conversation trees: summaries, branches, pages, fragments, cycles, episodes.

Nodes are (conversation_id, id, parent_id, role, content, timestamp_ns). Paths from leaf to root come
from doubling: each round joins every node's reach with that of the node it reaches, so a tree of
depth d takes log2(d) rounds instead of d.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

NODE = ["conversation_id", "id"]


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    parents = nodes.select("conversation_id", F.col("parent_id").alias("id")).where("id is not null")
    return nodes.join(parents, NODE, "left_anti")


def conversation_summaries(nodes: DataFrame) -> DataFrame:
    """One row a conversation: turns, last time, and its leaves, latest first, then by id."""
    ends = leaves(nodes).groupBy("conversation_id").agg(F.collect_list(F.struct((-F.col("timestamp_ns")).alias("t"), "id")).alias("l"))
    counts = nodes.groupBy("conversation_id").agg(F.count("*").alias("turns"), F.max("timestamp_ns").alias("latest_ns"))
    listed = F.transform(F.array_sort("l"), lambda x: x["id"])
    return counts.join(ends, "conversation_id", "left").select("conversation_id", "turns", "latest_ns", listed.alias("leaves"))


def depths(nodes: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(conversation_id, id, depth, root): distance to the root by doubling. A node on a cycle, or
    whose ancestor is missing, has no row."""
    up = nodes.select("conversation_id", "id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("steps"), F.when(F.col("parent_id").isNull(), F.col("id")).alias("root"))
    up, reach = cut(up, "reach"), 1
    while reach <= most and not up.where("root is null").isEmpty():
        far = up.select("conversation_id", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("root").alias("root2"))
        joined = up.join(far, ["conversation_id", "up"], "left")
        done = F.col("root").isNotNull()
        new = cut(
            joined.where(done | F.col("steps2").isNotNull()).select(
                "conversation_id", "id",
                F.when(done, F.col("up")).otherwise(F.col("up2")).alias("up"),
                F.when(done, F.col("steps")).otherwise(F.col("steps") + F.col("steps2")).alias("steps"),
                F.when(done, F.col("root")).otherwise(F.col("root2")).alias("root"),
            ),
            "reach",
        )
        reach *= 2
        up = new
    return up.where("root is not null").select("conversation_id", "id", F.col("steps").alias("depth"), "root")


def paths(nodes: DataFrame, ends: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(conversation_id, leaf, id, back): the ancestors of each end (conversation_id, leaf), itself at 0.

    Doubling again: a path of 2^k nodes is joined with the ancestor tables of 1, 2, 4, ... steps, so
    work is in proportion to the paths. most: the longest path that is followed.
    """
    jump = cut(nodes.select("conversation_id", "id", F.col("parent_id").alias("to")).where("to is not null"), "jump")
    found, step = ends.select("conversation_id", "leaf", F.col("leaf").alias("id"), F.lit(0).alias("back")), 1
    jumps = []
    while step < most and not jump.isEmpty():
        jumps.append((step, jump))
        again = jump.select("conversation_id", F.col("id").alias("to"), F.col("to").alias("to2"))
        jump, step = cut(jump.join(again, ["conversation_id", "to"]).select("conversation_id", "id", F.col("to2").alias("to")), "jump"), step * 2
    for size, j in jumps:  # back < size so far: each ancestor is reached in one way
        more = found.join(j, NODE).select("conversation_id", "leaf", F.col("to").alias("id"), (F.col("back") + size).alias("back"))
        found = cut(found.union(more), "paths")  # each step would double the plan otherwise
    return found


def branch_points(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent has more than one child, with their number of siblings."""
    twigs = nodes.where("parent_id is not null").groupBy("conversation_id", "parent_id").agg(F.count("*").alias("children")).where("children > 1")
    return nodes.join(twigs, ["conversation_id", "parent_id"])


def windows(positions: DataFrame, key: list[str], size: int = 8, overlap: int = 2, tail: bool = True) -> DataFrame:
    """(key..., start, end): windows of size positions, size - overlap apart; positions: (key..., length).

    Shorter paths have no window but the tail: the last size positions, if no window ends there.
    """
    step, n = size - overlap, F.col("length")
    full = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(step))).otherwise(F.array().cast("array<bigint>"))
    starts = positions.select(*key, "length", full.alias("starts"))
    if tail:
        last = F.greatest(F.lit(0), n - size)
        missing = (n > 0) & ~F.array_contains("starts", last)
        starts = starts.withColumn("starts", F.when(missing, F.array_append("starts", last)).otherwise(F.col("starts")))
    return starts.select(*key, "length", F.explode("starts").alias("start")).select(*key, "start", F.least(F.col("start") + size, F.col("length")).alias("end"))


def range_text(rows: DataFrame, ranges: DataFrame, key: list[str], position: str = "position") -> DataFrame:
    """(key..., start, end, text): `role: content` of a range's turns, a line each, in order."""
    inside = ranges.join(rows, key).where((F.col(position) >= F.col("start")) & (F.col(position) < F.col("end")))
    lines = F.collect_list(F.struct(F.col(position), F.concat("role", F.lit(": "), "content").alias("line")))
    return inside.groupBy(*key, "start", "end").agg(F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n").alias("text"))


def cycles(rows: DataFrame, key: list[str], order: str) -> Column:
    """The response cycle of each turn: a new one begins at each user turn after the first."""
    seen = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy(*key).orderBy(order))
    return F.greatest(seen - 1, F.lit(0))


def packed_episodes(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, episode, start, end, bytes): cycles (key, cycle, start, end, bytes) of a conversation are
    packed in order while their bytes stay within limit; a larger cycle is an episode by itself.

    Greedy packing is no window, so a conversation's cycles, not its texts, go to one function call.
    """

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        out, f = [], f.sort_values("cycle")
        for r in f.itertuples(index=False):
            if out and out[-1][4] + r.bytes <= limit:
                out[-1][3], out[-1][4] = r.end, out[-1][4] + r.bytes
            else:
                out.append([r[0], len(out), r.start, r.end, r.bytes])
        return pd.DataFrame(out, columns=[key, "episode", "start", "end", "bytes"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "cycle", "start", "end", "bytes").groupBy(key).applyInPandas(pack, f"{key} {kind}, episode int, start long, end long, bytes long")


def bounded_evidence(rows: DataFrame, key: str, most_turns: int = 64, most_bytes: int = 128 * 1024) -> DataFrame:
    """Rows (key, rank, bytes, ...) that fit: best rank first, skipping what would pass a bound.

    Skipping is no window, so ranks and sizes stream by in order, and only what fits is joined with its
    row: no conversation is held at once. Ranks of a key are distinct.
    """
    kinds = dict(rows.dtypes)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, used = None, 0, 0
        for b in batches:
            kept = []
            for i, (k, n) in enumerate(zip(b.column(key).to_pylist(), b.column("bytes").to_pylist(), strict=True)):
                if i == 0 and now is None or k != now:
                    now, turns, used = k, 0, 0
                if turns < most_turns and used + n <= most_bytes:
                    turns, used = turns + 1, used + n
                    kept.append(i)
            yield b.take(pa.array(kept, pa.int64()))

    narrow = rows.select(key, "rank", "bytes").repartition(key).sortWithinPartitions(key, "rank")
    fits = narrow.mapInArrow(take, f"{key} {kinds[key]}, rank {kinds['rank']}, bytes {kinds['bytes']}")
    return rows.join(fits.select(key, "rank"), [key, "rank"], "left_semi").select(rows.columns)


def coverage_gaps(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Ranges (key..., start, end) that don't begin where the one before ends (the first: at 0)."""
    before = F.lag("end", 1, 0).over(Window.partitionBy(*key).orderBy("start", "end"))
    return ranges.withColumn("expected", before).where(F.col("start") != F.col("expected"))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, key): the rows that checks found, each as one string key."""
    out: Iterator[DataFrame] = (df.select(F.lit(name).alias("check"), F.concat_ws("|", *df.columns).alias("key")) for name, df in checks.items())
    first, *rest = out
    for df in rest:
        first = first.union(df)
    return first
