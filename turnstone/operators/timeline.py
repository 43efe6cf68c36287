"""Versioned append-only logs: current state, cuts in time, as-of lookups, checks.

A log has dense versions from 1. What needs the order of a whole log (running maxima, gaps) is
worked out in chunks of versions: inside a chunk by a window, between chunks over one row for each,
so that no task holds the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .order import numbered

#: Versions of a chunk.
CHUNK = 1 << 16


def latest(log: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row with the largest version of each key."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")


def running_max(log: DataFrame, version: str, value: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """The log with out: the largest value up to each version."""
    part = log.withColumn("_chunk", F.expr(f"{version} div {chunk}"))
    tops = part.groupBy("_chunk").agg(F.max(value).alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))  # a row a chunk
    inside = F.max(value).over(Window.partitionBy("_chunk").orderBy(version).rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("_inside", inside).join(before.select("_chunk", "_before"), "_chunk").withColumn(out, F.greatest("_inside", "_before")).drop("_chunk", "_inside", "_before")


def first_gap(log: DataFrame, version: str, chunk: int = CHUNK) -> DataFrame:
    """One row (missing): the least version from 1 that the log lacks; its length + 1 if it is dense."""
    part = log.select(version).distinct().where(F.col(version) >= 1).withColumn("_chunk", F.expr(f"({version} - 1) div {chunk}"))
    # a chunk is full up to its first missing version
    rank = F.row_number().over(Window.partitionBy("_chunk").orderBy(version)) - 1 + F.col("_chunk") * chunk + 1
    full = part.withColumn("_ok", F.col(version) == rank).groupBy("_chunk").agg(F.count_if("_ok").alias("_full"))
    ordered = full.withColumn("_k", F.row_number().over(Window.orderBy("_chunk")) - 1).withColumn("_stop", (F.col("_full") < chunk) | (F.col("_k") != F.col("_chunk")))  # a row a chunk
    ends = ordered.agg(
        F.min(F.when(F.col("_stop"), F.when(F.col("_k") != F.col("_chunk"), F.col("_k") * chunk + 1).otherwise(F.col("_chunk") * chunk + F.col("_full") + 1))).alias("at"),
        F.max(F.col("_chunk") * chunk + F.col("_full") + 1).alias("end"),
    )
    return ends.select(F.coalesce("at", "end", F.lit(1)).cast("long").alias("missing"))


def versions_at(log: DataFrame, times: DataFrame, version: str, time: str, chunk: int = CHUNK) -> DataFrame:
    """(at, version) for each asked time: the largest version of the gapless prefix whose running
    maximum of times is at most at; null if there is none. times: (at)."""
    prefix = log.join(F.broadcast(first_gap(log, version)), F.col(version) < F.col("missing"))  # one row
    tops = running_max(prefix.select(version, time), version, time, "top", chunk).select(F.expr(f"{version} div {chunk}").alias("_c"), F.col(version).alias("_v"), "top")
    asked = times.select("at").distinct()
    # The running maximum never falls: of each time, all chunks that end at or under it count whole,
    # and only the one after them is looked into. Times and ends of chunks are put in one order; the
    # last chunk before a time is carried forward to it.
    ends = cut(tops.groupBy("_c").agg(F.max("top").alias("_end"), F.max("_v").alias("_last")), "chunks")
    line = asked.select("at", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_c")).union(ends.select("_end", F.lit(0), "_c"))
    carried = running_max(numbered(line, ["at", "_kind"], "_place"), "_place", "_c", "_prev", chunk).where("_kind = 1")
    first = ends.agg(F.min("_c").alias("_first"))  # one row
    placed = cut(carried.join(first).select("at", "_prev", F.coalesce(F.col("_prev") + 1, "_first").alias("_c")), "placed")
    whole = placed.join(ends.select(F.col("_c").alias("_prev"), F.col("_last").alias("_whole")), "_prev", "left").select("at", "_whole")
    after = placed.select("at", "_c")
    inside = after.join(tops, "_c").where(F.col("top") <= F.col("at")).groupBy("at").agg(F.max("_v").alias("_inside"))
    return whole.join(inside, "at", "left").select("at", F.greatest("_whole", "_inside").alias("version"))


def as_of(left: DataFrame, log: DataFrame, key: list[str], at: str, version: str, columns: list[str]) -> DataFrame:
    """left with columns of the log row of its key with the largest version at or under at.

    Both sides are put in one order and the last log row is carried forward, so a key's rows are
    neither paired with each other nor held at once.
    """
    value = F.struct(F.col(version), *columns)
    asks = left.withColumn("_time", F.col(at)).withColumn("_row", F.lit(None).cast(log.select(value.alias("v")).schema["v"].dataType)).withColumn("_ask", F.lit(1))
    facts = log.select(*key, F.col(version).alias("_time"), value.alias("_row")).withColumn("_ask", F.lit(0))
    both = facts.unionByName(asks, allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("_time", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_row", ignorenulls=True).over(order)).where("_ask = 1")
    return seen.select(*left.columns, *(F.col(f"_seen.{c}").alias(c) for c in [version, *columns]))


def dense_errors(log: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows whose version doesn't follow the one before it in its key by one (the first: 1)."""
    before = F.lag(version, 1, 0).over(Window.partitionBy(*key).orderBy(version))
    return log.withColumn("expected", before + 1).where(F.col(version) != F.col("expected"))


def repeated_versions(logs: dict[str, DataFrame], version: str) -> DataFrame:
    """Versions that occur more than once over several logs, and where."""
    parts = [df.select(F.col(version).alias("version"), F.lit(name).alias("log")) for name, df in logs.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("version").agg(F.count("*").alias("times"), F.array_join(F.array_sort(F.collect_set("log")), ",").alias("logs")).where("times > 1")


def published(log: DataFrame, incoming: DataFrame, key: list[str], mutation: str, revision: str, fixed: str) -> DataFrame:
    """incoming with outcome: `repeated` (its mutation is in the log), `stale` (its revision doesn't
    follow the current one), `changed` (its fixed column differs from the current one's) or `ok`."""
    now = latest(log, key, revision).select(*key, F.col(revision).alias("_now"), F.col(fixed).alias("_fixed"))
    known = log.select(mutation).distinct().withColumn("_known", F.lit(True))
    joined = incoming.join(known, mutation, "left").join(now, key, "left")
    outcome = (
        F.when(F.col("_known"), "repeated")
        .when(F.col(revision) != F.coalesce("_now", F.lit(0)) + 1, "stale")
        .when(F.col("_fixed").isNotNull() & ~F.col("_fixed").eqNullSafe(F.col(fixed)), "changed")
        .otherwise("ok")
    )
    return joined.withColumn("outcome", outcome).drop("_known", "_now", "_fixed")


def appended(log: DataFrame, incoming: DataFrame, key: list[str], mutation: str, revision: str, fixed: str) -> DataFrame:
    """The log with the incoming rows that may be published (see `published`)."""
    return log.unionByName(published(log, incoming, key, mutation, revision, fixed).where("outcome = 'ok'").select(log.columns))


def at_revision(log: DataFrame, asked: DataFrame, key: list[str], revision: str) -> DataFrame:
    """The log's rows of stated keys and revisions."""
    return log.join(asked, [*key, revision], "left_semi")


def changes(log: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one just before it: a repeated last value is not appended."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    return log.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def first_known(*columns: Column) -> Column:
    """The first of several sources of a time that is known."""
    return F.coalesce(*columns)
