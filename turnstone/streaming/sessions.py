"""Sessions by inactivity and by control events, recovery, windows and episodes with state, leases and
receipts as tables. `live` has what needs timers, `receipts` the table that a stream writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A gap of this many seconds, or more, ends a session.
GAP = 15 * 60


def sessions(events: DataFrame, key: str, time: str, gap: int = GAP) -> DataFrame:
    """Batch: (key, session, start, end, n) of events; time in seconds. A gap of exactly `gap` cuts."""
    w = Window.partitionBy(key).orderBy(time)
    first = F.when(F.col(time) - F.lag(time).over(w) < gap, 0).otherwise(1)
    numbered = events.select(key, time).withColumn("_new", first).withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


def session_stream(events: DataFrame, key: str, time: str, gap: int = GAP, late: str = "1 hour") -> DataFrame:
    """Streaming: the same sessions by event time, each emitted once its gap has passed.

    session_window merges events that are exactly its gap apart, so the window is a millisecond
    shorter. Events later than `late` behind the watermark are dropped by Spark.
    """
    w = F.session_window(time, f"{gap * 1000 - 1} milliseconds")
    return events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).select(key, "start", "end", "n")


def claim(ready: DataFrame, worker: str, now: int, lease: int, n: int) -> DataFrame:
    """The first n rows of claimable work (place, episode_id, attempt) leased to a worker: a token hashes
    work, attempt and worker, so a repeated claim gives the same."""
    first = ready.orderBy("place").limit(n)
    token = F.sha2(F.concat_ws(":", "episode_id", F.col("attempt") + 1, F.lit(worker)), 256)
    return first.select("episode_id", (F.col("attempt") + 1).alias("attempt"), F.lit(now + lease).alias("lease_until"), token.alias("token"))


def upsert(current: DataFrame, receipts: DataFrame) -> DataFrame:
    """State (episode_id, attempt, result) after receipts: the larger attempt wins, equal ones once, and a
    smaller never comes back. For use in foreachBatch: applying a batch twice changes nothing."""
    both = current.select("episode_id", "attempt", "result").union(receipts.select("episode_id", "attempt", "result"))
    best = F.max_by(F.struct("attempt", "result"), F.struct("attempt", "result"))
    return both.groupBy("episode_id").agg(best.alias("b")).select("episode_id", "b.attempt", "b.result")


def cut_sessions(events: DataFrame, key: str, time: str, control: str, gap: int = GAP) -> DataFrame:
    """Batch: sessions as `sessions`, with boundary: a control event (`explicit`, `create_memory`) ends the
    session that it is the last of; else `inactivity`, or `open` for a key's last. control: null or one of
    the two."""
    w = Window.partitionBy(key).orderBy(time, control)
    before = F.lag(control).over(w)
    new = F.when((F.col(time) - F.lag(time).over(w) < gap) & before.isNull(), 0).otherwise(1)
    rows = events.select(key, time, control).withColumn("_new", new)
    rows = rows.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = rows.groupBy(key, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), F.max(control).alias("_c"))
    last = F.max("session").over(Window.partitionBy(key)) == F.col("session")
    return s.withColumn("_last", last).select(key, "session", "start", "end", "n", F.coalesce("_c", F.when(F.col("_last"), "open").otherwise("inactivity")).alias("boundary"))


def open_sessions(log: DataFrame) -> DataFrame:
    """(session, state, leaf, problems) after a log (session, sequence, op, leaf) of open, move and close: the
    leaf is the last one named; opening an open session, and moving or closing one that isn't, are problems
    and change nothing."""
    w = Window.partitionBy("session").orderBy("sequence")
    # open and close alternate in effect: what holds before a row is the last effective one of the two
    marks = log.where("op in ('open', 'close')")
    is_open = F.last(F.when(F.col("op").isin("open", "close"), F.col("op") == "open"), ignorenulls=True)
    rows = log.withColumn("_before", F.coalesce(is_open.over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    bad = ((F.col("op") == "open") & F.col("_before")) | ((F.col("op") != "open") & ~F.col("_before"))
    ends = marks.groupBy("session").agg((F.max_by("op", "sequence") == "open").alias("open"))
    named = rows.withColumn("_bad", bad).groupBy("session").agg(F.max_by("leaf", F.when(~F.col("_bad") & F.col("leaf").isNotNull(), F.col("sequence"))).alias("leaf"), F.count_if("_bad").alias("problems"))
    return named.join(ends, "session", "left").select("session", F.when(F.coalesce("open", F.lit(False)), "open").otherwise("closed").alias("state"), "leaf", "problems")


def checkpointed(parts: DataFrame) -> DataFrame:
    """(message_id, state, text, chunks): what a restart finds of messages (message_id, sequence, kind,
    text): those with an end as they ended, the rest interrupted with the text so far. Equal repeats are
    one; a sequence that holds two things makes a conflict."""
    once = parts.select("message_id", "sequence", "kind", F.coalesce("text", F.lit("")).alias("text")).distinct()
    clash = once.groupBy("message_id", "sequence").agg(F.count("*").alias("_n"))
    bad = clash.groupBy("message_id").agg((F.max("_n") > 1).alias("_bad"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("sequence", "text")))), lambda x: x["text"]), "")
    end = F.max_by(F.when(F.col("kind").isin("complete", "cancel", "interrupt"), F.col("kind")), F.when(F.col("kind").isin("complete", "cancel", "interrupt"), F.col("sequence")))
    by = once.groupBy("message_id").agg(text.alias("text"), end.alias("_end"), F.count_if(F.col("kind") == "text").alias("chunks"))
    return by.join(bad, "message_id").select("message_id", F.when(F.col("_bad"), "conflict").otherwise(F.coalesce("_end", F.lit("interrupt"))).alias("state"), "text", "chunks")


def window_stream(turns: DataFrame, size: int = 8, overlap: int = 2) -> DataFrame:
    """Streaming: (conversation_id, start, end, text): windows of `size` turns, `size - overlap` apart, each
    as soon as its turns (conversation_id, position, role, content) are there, in whatever order they come.
    State: the turns of windows that aren't out yet. A turn that comes again is ignored."""
    step = size - overlap

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begin, held = 0, {}
        if state.exists:
            begin, places, lines = state.get
            held = dict(zip(places, lines, strict=True))
        for f in frames:
            for r in f.itertuples(index=False):
                if r.position >= begin:
                    held.setdefault(int(r.position), f"{r.role}: {r.content}")
        out = []
        while all(p in held for p in range(begin, begin + size)):
            out.append((key[0], begin, begin + size, "\n".join(held[p] for p in range(begin, begin + size))))
            begin += step
            held = {p: x for p, x in held.items() if p >= begin}
        places = sorted(held)
        state.update((begin, places, [held[p] for p in places]))
        yield pd.DataFrame(out, columns=["conversation_id", "start", "end", "text"])

    kind = dict(turns.dtypes)["conversation_id"]
    return turns.select("conversation_id", "position", "role", "content").groupBy("conversation_id").applyInPandasWithState(update, f"conversation_id {kind}, start long, end long, text string", "begin long, places array<long>, lines array<string>", "append", "NoTimeout")


def episode_stream(cycles: DataFrame, limit: int) -> DataFrame:
    """Streaming: (conversation_id, episode, start, end, bytes): cycles (conversation_id, cycle, start, end,
    bytes) packed while their bytes stay within limit, each episode when the next one begins; the open tail
    is kept. Cycles that come early wait for those before them; one that comes again is ignored."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, nxt, tail, early = 0, 0, None, {}
        if state.exists:
            done, nxt, start, end, size, keys, starts, ends, sizes = state.get
            tail = None if start is None else [start, end, size]
            early = {k: (a, b, n) for k, a, b, n in zip(keys, starts, ends, sizes, strict=True)}
        for f in frames:
            for r in f.itertuples(index=False):
                if r.cycle >= nxt:
                    early.setdefault(int(r.cycle), (int(r.start), int(r.end), int(r.bytes)))
        out = []
        while nxt in early:
            a, b, n = early.pop(nxt)
            nxt += 1
            if tail and tail[2] + n <= limit:
                tail = [tail[0], b, tail[2] + n]
            else:
                if tail:
                    out.append((key[0], done, *tail))
                    done += 1
                tail = [a, b, n]
        keys = sorted(early)
        state.update((done, nxt, *(tail or (None, None, None)), keys, *([early[k][i] for k in keys] for i in range(3))))
        yield pd.DataFrame(out, columns=["conversation_id", "episode", "start", "end", "bytes"])

    kind = dict(cycles.dtypes)["conversation_id"]
    held = "done long, next long, start long, end long, size long, keys array<long>, starts array<long>, ends array<long>, sizes array<long>"
    return cycles.select("conversation_id", "cycle", "start", "end", "bytes").groupBy("conversation_id").applyInPandasWithState(update, f"conversation_id {kind}, episode long, start long, end long, bytes long", held, "append", "NoTimeout")
