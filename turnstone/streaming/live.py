"""Streams with keyed state and timers: messages that arrive in parts, live sessions, the work queue.

Each is a stateful processor for `transformWithState`, which needs the RocksDB state store. By
default timers follow the watermark of the rows' own time `at`, so that a stream that is run again
gives the same; with clock="wall" they follow the machine's time. What lies further behind the
watermark than `late` is dropped by Spark; a message or session that old has been ended by its timer.

A key's state costs a few calls to the JVM for each batch, however small it is. Messages and works
are many and small, so those of a bucket share their state and one timer; sessions have their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ENDS = ("complete", "cancel", "interrupt")
#: Buckets of ids that share their state. It belongs to a stream's checkpoint and stays as it is.
BUCKETS = 1024
_HOUR = 3_600_000


class _Timed(StatefulProcessor):
    """A processor with one timer a key at most. columns: of its output."""

    columns: list[str] = []

    def __init__(self, wall: bool):
        self.wall = wall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def wake(self, at: int | None) -> None:
        """Moves the key's timer to a time in milliseconds, or takes it away."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def now(self, rows: list, timers) -> int:
        """The latest time of rows, or the machine's."""
        return timers.getCurrentProcessingTimeInMs() if self.wall else max(int(r.at.timestamp() * 1000) for r in rows)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = [r for f in rows for r in f.itertuples(index=False)]
        yield self.frame(self.take(key, got, self.now(got, timerValues)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.timer.exists() and self.timer.get()[0] == at:
            self.timer.clear()
            yield self.frame(self.expire(key, at))

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, processor: _Timed, schema: str, late: str, initial: DataFrame | None = None) -> DataFrame:
    rows.sparkSession.conf.set(*STORE)
    if not processor.wall:
        rows = rows.withWatermark("at", late)
    first = initial.groupBy(key) if initial is not None else None
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if processor.wall else "EventTime", first)


class _Bucketed(_Timed):
    """A processor of buckets of ids, each with rows of its own and a time to wake at. fields: of a row.

    A bucket is read and written as a whole, so a batch takes a few calls for each bucket that it meets.
    """

    fields = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", f"id string, wake long, {self.fields}")

    def load(self) -> dict[str, tuple[int | None, list[tuple]]]:
        """Of each id when to wake, and its rows."""
        out = {}
        for i, wake, *row in self.held.get() if self.held.exists() else ():
            out.setdefault(i, (wake, []))[1].append(tuple(row))
        return out

    def save(self, ids: dict[str, tuple[int | None, list[tuple]]]) -> None:
        rows = [(i, wake, *row) for i, (wake, held) in ids.items() for row in held]
        if rows:
            self.held.put(rows)
        elif self.held.exists():
            self.held.clear()
        self.wake(min((wake for wake, held in ids.values() if held and wake is not None), default=None))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids, by, out = self.load(), {}, []
        for f in rows:
            for r in f.itertuples(index=False):
                by.setdefault(r.id, []).append(r)
        for i, got in by.items():
            wake, held = ids.get(i, (None, []))
            more, *ids[i] = self.taken(i, wake, held, got, self.now(got, timerValues))
            out += more
        self.save(ids)
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.timer.exists() and self.timer.get()[0] == at:
            self.timer.clear()
            past = timerValues.getCurrentProcessingTimeInMs() if self.wall else timerValues.getCurrentWatermarkInMs()
            ids, out = self.load(), []
            for i, (wake, held) in ids.items():
                if wake is not None and (wake <= at or wake < past):
                    more, *ids[i] = self.expired(i, wake, held)
                    out += more
            self.save(ids)
            yield self.frame(out)


def _run_buckets(rows: DataFrame, key: str, processor: _Bucketed, schema: str, late: str, initial: DataFrame | None = None) -> DataFrame:
    """As _run, by buckets of ids. A processor has ids as strings."""
    named = lambda df: df.withColumn("id", F.col(key).cast("string")).withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")).drop(key)
    out = _run(named(rows), "_bucket", processor, f"{key} string, {schema}", late, named(initial) if initial is not None else None)
    return out.withColumn(key, F.col(key).cast(dict(rows.dtypes)[key]))


# -- messages -----------------------------------------------------------------


class Messages(_Bucketed):
    columns = ["message_id", "state", "text", "chunks", "files"]
    fields = "ended string, sequence int, kind string, text string"

    def __init__(self, idle: int, keep: int, wall: bool):
        super().__init__(wall)
        self.idle, self.keep = idle, keep

    def taken(self, name: str, wake: int | None, held: list[tuple], rows: list, now: int) -> tuple[list[tuple], int | None, list[tuple]]:
        """What rows of a message give, when to wake next, what is held; one row without a part, once it has ended."""
        if held and held[0][0]:
            return [], wake, held
        parts = {s: (kind, text) for _, s, kind, text in held}
        conflict = False
        for r in rows:
            part = (r.kind, r.text or "")
            conflict |= parts.setdefault(int(r.sequence), part) != part
        end = min((s for s, (kind, _) in parts.items() if kind in ENDS), default=None)
        if conflict:
            return self.finish(name, "conflict", parts, now)
        if end is not None and all(s in parts for s in range(end)):
            return self.finish(name, parts[end][0], {s: p for s, p in parts.items() if s <= end}, now)
        return [], now + self.idle, [(None, s, *p) for s, p in parts.items()]

    def finish(self, name: str, state: str, parts: dict[int, tuple[str, str]], now: int) -> tuple[list[tuple], int | None, list[tuple]]:
        texts = [t for _, (kind, t) in sorted(parts.items()) if kind == "text"]
        files = ",".join(t for _, (kind, t) in sorted(parts.items()) if kind == "attach")
        return [(name, state, "".join(texts), len(texts), files)], now + self.keep, [(state, None, None, None)]

    def expired(self, name: str, at: int, held: list[tuple]) -> tuple[list[tuple], int | None, list[tuple]]:
        if held[0][0]:
            return [], None, []
        return self.finish(name, "interrupt", {s: (kind, text) for _, s, kind, text in held}, at)


def assembled(parts: DataFrame, idle: int = _HOUR, keep: int = 24 * _HOUR, late: str = "24 hours", clock: str = "event") -> DataFrame:
    """Streaming: (message_id, state, text, chunks, files), a row when a message ends.

    parts: (message_id, sequence, kind, text, at), kind one of begin, text, attach (text: a file),
    complete, cancel, interrupt. Sequences start at 0 without gaps; parts come in any order over any
    number of batches, and a message ends once its first ending part and all before it are there. A
    repeated part changes nothing; two different parts of one sequence make the message a conflict. A
    message that gets nothing for `idle` milliseconds is interrupted, with the text so far. What comes
    for a message that has ended is silent for `keep` milliseconds; then its key is forgotten.
    """
    kept = parts.select("message_id", "sequence", "kind", "text", *(["at"] if clock == "event" else []))
    return _run_buckets(kept, "message_id", Messages(idle, keep, clock == "wall"), "state string, text string, chunks int, files string", late)


# -- sessions -----------------------------------------------------------------


class Sessions(_Timed):
    columns = ["session", "sequence", "outcome", "message_id", "parent", "text", "files"]

    def __init__(self, idle: int, keep: int, wall: bool):
        super().__init__(wall)
        self.idle, self.keep = idle, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.head = handle.getValueState("head", "next long, open boolean, leaf string, flight string, parent string")
        self.chunks = handle.getListState("chunks", "text string")
        self.files = handle.getListState("files", "file string")
        self.early = handle.getMapState("early", "sequence long", "op string, message_id string, text string")
        self.durable = handle.getMapState("durable", "message_id string", "sequence long")

    def take(self, key: tuple, rows: list, now: int) -> list[tuple]:
        head = list(self.head.get()) if self.head.exists() else [0, False, None, None, None]
        waiting = {k[0]: tuple(v) for k, v in self.early.iterator()}
        for r in rows:
            if r.sequence >= head[0] and r.sequence not in waiting:
                waiting[r.sequence] = (r.op, r.message_id, r.text)
                self.early.updateValue((int(r.sequence),), waiting[r.sequence])
        out = []
        while head[0] in waiting:
            seq = head[0]
            out += [(key[0], seq, *row) for row in self.apply(head, seq, *waiting.pop(seq))]
            if self.early.containsKey((seq,)):
                self.early.removeKey((seq,))
            head[0] += 1
        self.head.update(tuple(head))
        self.wake(now + (self.idle if head[3] or waiting else self.keep))
        return out

    def apply(self, head: list, seq: int, op: str, message: str | None, text: str | None) -> list[tuple]:
        """The rows that an operation in its turn gives; head is changed."""
        _, is_open, leaf, flight, parent = head
        refused = lambda why: [(why, message, None, None, None)]
        if op == "open":
            if is_open:
                return refused("already open")
            if message and not self.durable.containsKey((message,)):
                return refused("missing resume")
            if not message and next(iter(self.durable.keys()), None) is not None:
                return refused("resume required")
            head[1], head[2] = True, message or None
            return [("opened", message, None, None, None)]
        if op == "begin" and message and self.durable.containsKey((message,)):
            return refused("already durable")
        if not is_open:
            return refused("unknown session")
        if op == "begin":
            if flight:
                return refused("in progress")
            if not message:
                return refused("invalid id")
            head[3], head[4] = message, leaf
            return []
        if op == "close":
            if flight:
                return refused("in progress")
            head[1], head[2] = False, None
            return [("closed", leaf, None, None, None)]
        if not flight:
            return refused("nothing in progress")
        if flight != message:
            return refused("mismatch")
        if op == "text":
            self.chunks.appendValue((text or "",))
            return []
        if op == "attach":
            self.files.appendValue((text or "",))
            return []
        said, files = self.dropped(head)
        if op == "cancel":
            return [("cancelled", message, parent, None, None)]
        head[2] = message
        self.durable.updateValue((message,), (seq,))
        return [("turn", message, parent, said, files)]

    def dropped(self, head: list) -> tuple[str, str]:
        """Text and files of the message in flight, which is in flight no longer."""
        said, files = "".join(x[0] for x in self.chunks.get()), ",".join(x[0] for x in self.files.get())
        self.chunks.clear()
        self.files.clear()
        head[3] = head[4] = None
        return said, files

    def expire(self, key: tuple, at: int) -> list[tuple]:
        head = list(self.head.get())
        if head[3]:
            message, parent = head[3], head[4]
            said, files = self.dropped(head)
            self.head.update(tuple(head))
            self.wake(at + self.keep)
            return [(key[0], head[0], "interrupted", message, parent, said, files)]
        for state in (self.head, self.early, self.durable):
            state.clear()
        return []


def live_sessions(events: DataFrame, idle: int = _HOUR, keep: int = 24 * _HOUR, late: str = "24 hours", clock: str = "event") -> DataFrame:
    """Streaming: (session, sequence, outcome, message_id, parent, text, files), what operations came to.

    events: (session, sequence, op, message_id, text, at): open (message_id: what it resumes from, or
    null), begin, text, attach, complete, cancel, close. They are applied in the order of their
    sequence, from 0 without gaps, in whatever order they come; one that comes again is silent. A
    completed message is a `turn` below the session's leaf and becomes the leaf. Other outcomes:
    opened, closed (message_id: the leaf), cancelled, interrupted (no event for `idle` milliseconds
    while a message was in flight), and why an operation was refused and changed nothing: already open,
    missing resume, resume required (the session has turns), already durable, unknown session, in
    progress, invalid id, nothing in progress, mismatch. A session at rest for `keep` is forgotten.
    """
    kept = events.select("session", "sequence", "op", "message_id", "text", *(["at"] if clock == "event" else []))
    return _run(kept, "session", Sessions(idle, keep, clock == "wall"), f"session {dict(events.dtypes)['session']}, sequence long, outcome string, message_id string, parent string, text string, files string", late)


# -- the work queue -----------------------------------------------------------


class Work(_Bucketed):
    columns = ["episode_id", "sequence", "op", "outcome", "state", "attempt", "token", "lease_until", "retry_after", "error"]
    fields = "state string, attempt long, token string, lease_until long, retry_after long, error string"

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        none = lambda v: None if pd.isna(v) else v
        ids = self.load()
        for r in initialState.itertuples(index=False):
            w = (r.state, int(r.attempt), none(r.token), *(None if pd.isna(x) else int(x) for x in (r.lease_until, r.retry_after)), none(r.error))
            ids[r.id] = (self.due(w), [w])
        self.save(ids)

    @staticmethod
    def due(w: tuple) -> int | None:
        """When a lease lapses or a retry comes."""
        return {"processing": w[3], "failed": w[4]}.get(w[0])

    def taken(self, episode: str, wake: int | None, held: list[tuple], rows: list, now: int) -> tuple[list[tuple], int | None, list[tuple]]:
        w, out = held[0] if held else None, []
        for r in sorted(rows, key=lambda r: r.sequence):
            outcome, w = self.after(episode, w, r)
            out.append((episode, int(r.sequence), r.op, outcome, *(w or (None,) * 6)))
        return out, self.due(w) if w else None, [w] if w else []

    @staticmethod
    def after(episode: object, w: tuple | None, r) -> tuple[str, tuple | None]:
        """(outcome, work) after a command; times are milliseconds."""
        at, until = int(r.at.timestamp() * 1000), None if pd.isna(r.until) else int(r.until)
        reason, token = (r.reason or "").strip(), r.token
        if r.op == "queue":
            return ("exists", w) if w else ("done", ("pending", 0, None, None, None, None))
        if w is None:
            return "missing work", w
        state, attempt, held, lease, retry, error = w
        if r.op == "claim":
            ready = state == "pending" or (state == "failed" and retry <= at) or (state == "processing" and lease <= at)
            if not (token or "").strip() or until is None or until <= at:
                return "invalid", w
            if not ready:
                return "not ready", w
            name = hashlib.sha256(f"{episode}:{attempt + 1}:{token.strip()}".encode()).hexdigest()
            return "done", ("processing", attempt + 1, name, until, None, None)
        if r.op == "retry":
            return ("done", ("pending", attempt, None, None, None, None)) if state == "terminal" else ("not terminal", w)
        if not (state == "processing" and held == token and lease > at):
            return "no live lease", w
        if r.op == "renew":
            return ("done", (state, attempt, held, until, retry, error)) if until is not None and until > lease else ("not later", w)
        if r.op == "fail":
            return ("done", ("failed", attempt, None, None, until, reason)) if reason and until is not None and until > at else ("invalid", w)
        if r.op == "terminal":
            return ("done", ("terminal", attempt, None, None, None, reason)) if reason else ("invalid", w)
        return "done", ("complete", attempt, None, None, None, error)

    def expired(self, episode: str, at: int, held: list[tuple]) -> tuple[list[tuple], int | None, list[tuple]]:
        state, attempt, _, _, _, error = held[0]
        w = ("pending", attempt, None, None, None, error)
        return [(episode, -1, "lapse" if state == "processing" else "due", "done", *w)], None, [w]


def work_stream(commands: DataFrame, initial: DataFrame | None = None, late: str = "1 minute") -> DataFrame:
    """Streaming: (episode_id, sequence, op, outcome, state, attempt, token, lease_until, retry_after,
    error): the work after each command, and (sequence -1) when a lease lapses or a retry comes due.

    commands: (episode_id, sequence, op, token, at, until, reason) with at a timestamp and until in
    milliseconds; those of a batch are applied by sequence. `queue` makes work, `claim` (token: the
    worker) leases work that is ready until `until`; renew, fail, terminal, complete and retry are those of
    `operators.queue.transitions`. initial: the work so far (episode_id, state, attempt, token,
    lease_until, retry_after, error). A lapsed lease makes its work pending by a timer, no pass needed.
    """
    kept = commands.select("episode_id", "sequence", "op", "token", "at", "until", "reason")
    schema = "sequence long, op string, outcome string, state string, attempt long, token string, lease_until long, retry_after long, error string"
    return _run_buckets(kept, "episode_id", Work(wall=False), schema, late, initial)
