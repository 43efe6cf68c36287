"""Streams with keyed state over several batches, with restarts."""

import pytest
from turnstone.streaming import live, receipts


class Feed:
    """A stream that is fed file by file; each `push` is a batch of a query that starts again from its
    checkpoint, as after a restart."""

    def __init__(self, spark, folder, schema, made):
        self.spark, self.folder, self.schema, self.made = spark, str(folder), schema, made

    def push(self, rows):  # a folder's files come by their time
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        out = self.made(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in"))
        self.out = out.schema
        q = out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        self.state_rows = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None

    def rows(self):
        return sorted((tuple(r) for r in self.spark.read.schema(self.out).parquet(f"{self.folder}/out").collect()), key=repr)


def at(minute):
    import datetime

    return datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=minute)


PARTS = "message_id string, sequence int, kind string, text string, at timestamp"


def test_messages_over_five_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, PARTS, lambda s: live.assembled(s, idle=60 * 60_000, keep=120 * 60_000, late="1 minute"))
    # an end that overtakes a text waits for it
    feed.push([("m1", 0, "begin", None, at(0)), ("m1", 1, "text", "ab", at(0)), ("m1", 2, "complete", None, at(0)), ("m2", 0, "begin", None, at(0)), ("m2", 3, "complete", None, at(0)), ("m2", 2, "text", "cd", at(0)), ("m4", 0, "text", "so far", at(0))])
    assert feed.rows() == [("m1", "complete", "ab", 1, "")]
    # a repeated end is silent, the text that lacked comes
    feed.push([("m1", 2, "complete", None, at(1)), ("m1", 2, "complete", None, at(1)), ("m2", 1, "text", "XX", at(1)), ("m3", 0, "text", "one", at(1)), ("m3", 0, "text", "other", at(1))])
    assert feed.rows() == [("m1", "complete", "ab", 1, ""), ("m2", "complete", "XXcd", 2, ""), ("m3", "conflict", "one", 1, "")]
    feed.push([("m2", 1, "text", "YY", at(2)), ("m5", 1, "cancel", None, at(2)), ("m5", 0, "attach", "f", at(2))])
    assert len(feed.rows()) == 4 and ("m5", "cancel", "", 0, "f") in feed.rows()
    full = feed.state_rows
    feed.push([("m6", 0, "begin", None, at(70))])  # m4 has had nothing for an hour
    assert ("m4", "interrupt", "so far", 1, "") in feed.rows() and len(feed.rows()) == 5
    feed.push([("m7", 0, "begin", None, at(400))])  # what has ended is forgotten
    feed.push([("m8", 0, "begin", None, at(401))])
    assert len(feed.rows()) == 6 and ("m6", "interrupt", "", 0, "") in feed.rows() and feed.state_rows < full


EVENTS = "session string, sequence long, op string, message_id string, text string, at timestamp"


def test_sessions_open_and_close_in_the_same_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS, lambda s: live.live_sessions(s, idle=60 * 60_000, keep=600 * 60_000, late="1 minute"))
    ev = lambda k, op, m=None, text=None, t=0: ("s", k, op, m, text, at(t))
    feed.push([ev(3, "text", "a", "lo"), ev(0, "open"), ev(2, "text", "a", "hel"), ev(5, "close")])
    assert feed.rows() == [("s", 0, "opened", None, None, None, None)]
    feed.push([ev(4, "complete", "a"), ev(1, "begin", "a"), ev(2, "text", "a", "hel")])
    assert feed.rows()[1:] == [("s", 4, "turn", "a", None, "hello", ""), ("s", 5, "closed", "a", None, None, None)]
    feed.push([ev(6, "text", "a", "x"), ev(7, "open"), ev(8, "open", "zz"), ev(9, "open", "a"), ev(10, "open", "a"), ev(11, "begin", "a"), ev(12, "begin", "b"), ev(13, "cancel", "c"), ev(14, "close"), ev(15, "text", "b", "half")])
    assert {r[1]: r[2] for r in feed.rows() if r[1] > 5} == {6: "unknown session", 7: "resume required", 8: "missing resume", 9: "opened", 10: "already open", 11: "already durable", 13: "mismatch", 14: "in progress"}
    feed.push([("t", 0, "open", None, None, at(90))])  # b is in flight for over an hour
    assert ("s", 16, "interrupted", "b", "a", "half", "") in feed.rows()
    feed.push([ev(16, "begin", "b", t=91), ev(17, "complete", "b", t=91)])
    assert ("s", 17, "turn", "b", "a", "", "") in feed.rows()


COMMANDS = "episode_id long, sequence long, op string, token string, at timestamp, until long, reason string"


def test_a_lapsed_lease_is_free_again(spark, tmp_path):
    ms = lambda minute: int(at(minute).timestamp() * 1000)
    feed = Feed(spark, tmp_path, COMMANDS, live.work_stream)
    feed.push([(1, 0, "queue", None, at(0), None, None), (1, 1, "claim", "w1", at(0), ms(5), None), (1, 2, "claim", "w2", at(1), ms(9), None), (2, 0, "claim", "w1", at(0), ms(5), None), (3, 0, "queue", None, at(0), None, None), (3, 1, "queue", None, at(0), None, None)])
    got = {(r[0], r[1]): r for r in feed.rows()}
    token = got[1, 1][6]
    assert [got[k][3] for k in ((1, 0), (1, 1), (1, 2), (2, 0), (3, 1))] == ["done", "done", "not ready", "missing work", "exists"] and len(token) == 64
    feed.push([(1, 3, "renew", token, at(4), ms(8), None), (1, 4, "renew", "other", at(4), ms(20), None), (9, 0, "queue", None, at(30), None, None)])
    got = {(r[0], r[1]): r for r in feed.rows()}
    assert got[1, 3][3:8] == ("done", "processing", 1, token, ms(8)) and got[1, 4][3] == "no live lease"
    assert got[1, -1][2:7] == ("lapse", "done", "pending", 1, None)  # by its timer, after a restart
    feed.push([(1, 5, "complete", token, at(31), None, None), (1, 6, "claim", "w2", at(31), ms(60), None)])
    got = {(r[0], r[1]): r for r in feed.rows()}
    assert got[1, 5][3] == "no live lease" and got[1, 6][3:6] == ("done", "processing", 2)


def test_a_batch_of_receipts_counts_once(spark, tmp_path, monkeypatch):
    schema, path = "episode_id long, attempt long, result string", str(tmp_path / "table")
    df = lambda *rows: spark.createDataFrame(rows, schema)
    now = lambda: sorted(map(tuple, receipts.current(spark, path, schema).collect()))
    assert now() == []
    receipts.apply_batch(path, df((1, 1, "a"), (2, 1, "b")), 0, buckets=4)
    receipts.apply_batch(path, df((1, 9, "never")), 0, buckets=4)  # the same batch again
    assert now() == [(1, 1, "a"), (2, 1, "b")]

    def dies(*_):
        raise RuntimeError("the driver dies between write and entry")

    with monkeypatch.context() as m:
        m.setattr(receipts, "enter", dies)
        with pytest.raises(RuntimeError):
            receipts.apply_batch(path, df((1, 2, "c"), (3, 1, "d")), 1, buckets=4)
    assert now() == [(1, 1, "a"), (2, 1, "b")] and receipts.entries(spark, path) == [0]
    receipts.apply_batch(path, df((1, 2, "c"), (3, 1, "d")), 1, buckets=4)  # tried again after the restart
    receipts.apply_batch(path, df((3, 0, "old")), 2, buckets=4)
    receipts.apply_batch(path, df(), 3, buckets=4)
    assert now() == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def test_works_and_messages_share_state_by_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "BUCKETS", 8, raising=False)
    ms, n = lambda minute: int(at(minute).timestamp() * 1000), 300
    feed = Feed(spark, tmp_path / "w", COMMANDS, live.work_stream)
    big = 2**60  # beyond a double's integers
    feed.push([(big + i, k, *c) for i in range(n) for k, c in enumerate([("queue", None, at(0), None, None), ("claim", "w", at(0), ms(1 + i % 5), None)])])
    assert feed.state_rows < n
    feed.push([(1, 0, "queue", None, at(4.5), None, None)])  # the leases of 1 and 2 lapse; a minute is waited
    feed.push([(2, 0, "queue", None, at(60), None, None)])
    feed.push([(3, 0, "queue", None, at(61), None, None)])
    lapsed = [r for r in feed.rows() if r[1] == -1]
    assert sorted(r[0] for r in lapsed) == [big + i for i in range(n)] and {r[2:6] for r in lapsed} == {("lapse", "done", "pending", 1)}
    parts = Feed(spark, tmp_path / "m", PARTS, live.assembled)
    parts.push([(f"m{i}", k, *p, at(0)) for i in range(n) for k, p in enumerate([("begin", None), ("text", f"t{i}")])])
    assert parts.state_rows < n and parts.rows() == []
    parts.push([(f"m{i}", 2, "complete", None, at(1)) for i in range(n)])
    assert parts.rows() == sorted((f"m{i}", "complete", f"t{i}", 1, "") for i in range(n))
