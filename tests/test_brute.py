"""Queries that SQL can't express against plain Python, and the temporal parser against sentences."""

import hashlib
import random
import struct
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from .test_queries import SF
from turnstone import catalog
from turnstone.functions import temporal as tl
from turnstone.operators import chronos, clustering, communities, queue, retrieval, store
from turnstone.streaming import sessions

catalog.load()
REFERENCE = int(pd.Timestamp("2026-08-24").value)


def rows_of(spark, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, SF).collect()]


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


# -- queries without SQL ------------------------------------------------------------------------


def test_bounded_evidence(spark):
    want, left = [], defaultdict(list)
    for r in table("conversations").itertuples():
        n = len(r.text.encode())
        left[r.conv_id].append((-n * 10 + r.turn, n, f"{r.conv_id}:{r.turn}"))
    for c, turns in left.items():
        used = kept = 0
        for rank, n, name in sorted(turns):
            if kept < 3 and used + n <= 700:
                want.append((c, name, n, rank))
                used, kept = used + n, kept + 1
    assert sorted(rows_of(spark, "bounded_evidence")) == sorted((c, i, n, rank) for c, i, n, rank in want)


def brute_centroids(vectors, count, rounds):
    """vectors: {id: vector}."""
    ids = sorted(vectors)
    u = {i: np.array(vectors[i], dtype=float) / np.linalg.norm(vectors[i]) for i in ids}
    unit = lambda x: x / np.linalg.norm(x)
    mean = unit(np.mean([np.array(vectors[i], dtype=float) for i in ids], axis=0))
    picks = [max(ids, key=lambda i: (round(u[i] @ mean, 9), i))]
    while len(picks) < min(count, len(ids)):
        picks.append(min(ids, key=lambda i: (max(round(u[i] @ u[p], 9) for p in picks), i)))
    centres = [u[p] for p in picks]
    for _ in range(rounds):
        own = {i: max(range(len(centres)), key=lambda k: (round(u[i] @ centres[k], 9), k)) for i in ids}
        centres = [unit(np.mean([np.array(vectors[i], dtype=float) for i in ids if own[i] == k], axis=0)) if k in own.values() else centres[k] for k in range(len(centres))]
    return centres


def test_subcentroids(spark):
    e = table("embeddings")
    got = {(r[0], r[1]): r[2] for r in rows_of(spark, "subcentroids")}
    for label, part in e.groupby("label"):
        want = brute_centroids({r.vec_id: r.embedding.astype(float) for r in part.itertuples()}, 2, 2)
        for k, c in enumerate(want):
            assert np.allclose(got[label, k], c, atol=2e-6)
    assert len(got) == 2 * e.label.nunique()
    few = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 5, [1.0, 0.0]), (2, 6, [0.0, 1.0]), (2, 7, None), (2, 8, [0.0, 0.0])], "community int, id long, vector array<double>")
    assert {(r.community, r.place): r.centroid for r in communities.sub_centroids(few, 3).collect()} == {(1, 0): [1.0, 0.0], (2, 0): [0.0, 1.0], (2, 1): [1.0, 0.0]}


def test_simulated_embedding_and_truncated_names(spark):
    from turnstone.operators.records import embedded, truncated

    texts = ["", "a", "ünï", "漢字" * 5]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "id long, text string")
    got = {r.id: r.vector for r in embedded(df, "id", "text", 10, "s").collect()}
    for i, t in enumerate(texts):
        raw = b"".join(hashlib.sha256(f"s/{k}/{t}".encode()).digest() for k in range(2))
        v = np.array(struct.unpack("<16i", raw)[:10], dtype=float)
        assert np.allclose(got[i], v / np.linalg.norm(v), atol=1e-6)
    assert got[9] is None
    for n in range(12):
        cut = {r.id: r.x for r in df.select("id", truncated(F.col("text"), n).alias("x")).collect()}
        assert all(cut[i] == t.encode()[:n].decode(errors="ignore") for i, t in enumerate(texts))


@pytest.mark.parametrize("shard", [8, 4096])
def test_leiden_is_a_partition_that_pays(spark, shard):
    edges = []
    for c in range(12):  # twelve groups of eight, bridged in a ring
        edges += [(c * 8 + i, c * 8 + j) for i in range(8) for j in range(i)] + [(c * 8, (c * 8 + 8) % 96)]
    df = spark.createDataFrame(edges + edges[:9] + [(b, a) for a, b in edges[:9]] + [(5, 5)], "a long, b long")
    home, grades = clustering.scan_and_merge(df, spark.createDataFrame([(7,), (500,)], "node long"), shard=shard)
    by = defaultdict(set)
    for r in home.collect():
        by[r.community].add(r.node)
    assert sorted(x for s in by.values() for x in s) == [*range(96), 500] and all(min(s) == c for c, s in by.items())
    assert by[500] == {500} and (shard < 96 or [by[c * 8] for c in range(12)] == [set(range(c * 8, c * 8 + 8)) for c in range(12)])
    assert communities.modularity(clustering.undirected(df), home).first().modularity > 0.75 and grades == sorted(grades)
    assert clustering.partition_report(df, home).first() == (97, len(by), len(by))


def test_leiden_of_few(spark):
    none = spark.createDataFrame([], "a long, b long")
    alone = spark.createDataFrame([(3,), (1,)], "node long")
    assert sorted(clustering.scan_and_merge(none, alone)[0].collect()) == [(1, 1), (3, 3)]
    assert clustering.scan_and_merge(none)[0].count() == 0
    star = spark.createDataFrame([(0, i) for i in range(1, 40)], "a long, b long")  # all want the same centre
    home, grades = clustering.scan_and_merge(star, shard=4)
    assert clustering.partition_report(star, home).first()[0] == 40 and grades == sorted(grades)


def walk(edges):
    """(node, root, level, position), with a queue."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, out = set(), []
    for root in sorted(near):
        if root in seen:
            continue
        seen.add(root)
        queue = [(root, 0)]
        for node, level in queue:
            out.append((node, root, level, len(out)))
            for n in sorted(near[node] - seen):
                seen.add(n)
                queue.append((n, level + 1))
    return out


def test_scan_order_is_that_of_a_queue(spark):
    rng = random.Random(1)
    edges = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(400)) if a != b] + [(1000 + i, 1001 + i) for i in range(5)]
    df = spark.createDataFrame(edges, "a long, b long")
    order = clustering.scan_order(df).collect()
    assert sorted(order) == sorted(walk(edges))
    place = {r.node: r.position for r in order}
    for r in clustering.scan_plan(df, clustering.scan_order(df), shard=16).collect():
        x, y, level = place[r.a] // 16, place[r.b] // 16, 0
        while x != y:
            x, y, level = x // 2, y // 2, level + 1
        assert (r.level, r.parent) == (level, x)


def test_chronos_full_says_what_the_sentences_say(spark):
    o, kinds = table("orders"), defaultdict(list)
    for r in catalog.QUERIES["chronos_full"](spark, SF).collect():
        kinds[r.o_orderkey].append((r.kind, r.granularity, r.evidence))
    for r in o.itertuples():
        day, k = f"{r.o_orderdate:%Y-%m-%d}", r.o_orderkey % 4
        month, quarter = f"{r.o_orderdate:%Y-%m}", f"Q{(r.o_orderdate.month + 2) // 3} {r.o_orderdate.year}"
        want = {
            0: [("anchor", "day", day)],
            1: [("anchor", "day", day), ("anchor", "quarter", quarter)],
            2: [("anchor", "month", month), ("duration", "week", "for two weeks")],
            3: [("anchor", "day", "three mnoths ago"), ("boundary", "day", f"since {day}"), ("recurrence", "week", "weekly")],
        }[k]
        assert sorted(kinds[r.o_orderkey]) == sorted(want)


# -- temporal language --------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "kind", "start", "end"),
    [
        ("since May", "boundary", "2026-05-01", None),
        ("until Friday", "boundary", None, "2026-08-29"),
        ("after 2026-10-01", "boundary", "2026-10-02", None),
        ("before 2026-12-01", "boundary", None, "2026-12-01"),
        ("three mnoths ago", "anchor", "2026-05-24", "2026-05-25"),
        ("next Wendesday", "anchor", "2026-08-26", "2026-08-27"),
        ("from November to February", "anchor", "2026-11-01", "2027-03-01"),
        ("from November to February", "interval", "2026-11-01", "2027-03-01"),
        ("from Friday to Monday", "anchor", "2026-08-28", "2026-09-01"),
        ("2026-01-03 to 2026-01-05", "interval", "2026-01-03", "2026-01-06"),
        ("Q2 2026", "anchor", "2026-04-01", "2026-07-01"),
        ("March 5, 2026", "anchor", "2026-03-05", "2026-03-06"),
        ("5th of March 2026", "anchor", "2026-03-05", "2026-03-06"),
        ("next month", "anchor", "2026-09-01", "2026-10-01"),
        ("last week", "anchor", "2026-08-17", "2026-08-24"),
        ("in two quarters", "anchor", "2027-02-24", "2027-02-25"),
        ("southern summer 2025", "anchor", "2025-12-01", "2026-03-01"),
        ("in 2027", "anchor", "2027-01-01", "2028-01-01"),
    ],
)
def test_sentences(text, kind, start, end):
    ns = lambda d: None if d is None else int(pd.Timestamp(d).value)
    assert (kind, ns(start), ns(end)) in [(f.kind, f.start_ns, f.end_ns) for f in tl.parse(f"It was {text}.", REFERENCE)]


@pytest.mark.parametrize("text", ["9999-12-31", "in 9999 years", "9999 years ago", "from 9999-12-31 to 2000-01-01", "2300-01-01", "0000-01-01", "northern winter 9999", "Q4 9999", "next year"])
@pytest.mark.parametrize("reference", [None, REFERENCE, 9 * 10**18, -(9 * 10**18), 253402300799 * 10**9, -62135596800 * 10**9])
def test_ends_of_the_calendar(text, reference):
    for f in tl.parse(text, reference):
        assert all(x is None or -(1 << 63) <= x < 1 << 63 for x in (f.start_ns, f.end_ns))


def test_full_dates_do_not_roll():
    assert [f.kind for f in tl.parse("from 2026-05-10 to 2026-05-01", REFERENCE) if f.granularity == "range"] == []


def test_detection():
    found = lambda t: [(d["kind"], d["evidence"], d["normalized"]) for d in tl.detect(t)]
    assert found("They march in May, every week since Monday.") == [("calendar", "May", None), ("recurrence", "every", None), ("duration", "week", None), ("boundary", "since", None), ("calendar", "Monday", None)]
    assert found("three mnoths ago at 10:30, in 1999, number 1999") == [("duration", "mnoths", "months"), ("relative", "ago", None), ("explicit", "10:30", None), ("explicit", "1999", None)]
    assert found("") == found(None) == [] and found("I may fall") == []
    assert tl.status([], []) == "none" and tl.status(tl.parse("tomorrow", REFERENCE), tl.detect("tomorrow")) == "resolved"
    assert tl.status(tl.parse("tomorrow"), tl.detect("tomorrow")) == "unresolved"


def test_at_most_six_matches(spark):
    days = " ".join(f"2026-01-{d:02}" for d in range(1, 9))
    df = spark.createDataFrame([(1, days, None), (2, days + " every Monday", None), (3, "every Monday 2026-01-01 to 2026-01-31", None), (4, None, None)], "id long, text string, r long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "source long, candidate long")
    got = {(r.source, r.candidate): (r.matches, r.best) for r in chronos.pair_matches(pairs, chronos.analysed(df, "id", "text", "r"), "id").collect()}
    assert got == {(1, 2): (6, 0.98), (2, 3): (6, 0.75)}


# -- edges of the newer operators ---------------------------------------------------------------


def test_index_ahead_of_its_log_is_built_anew(spark):
    slots = spark.createDataFrame([(7, True), (8, False)], "id long, active boolean")
    log = spark.createDataFrame([(1, 1, False), (2, 2, True), (1, 3, True), (3, 4, False)], "id long, version long, archived boolean")
    get = lambda mark, version: {r.id: r.active for r in retrieval.index_slots(slots, mark, log, version).collect()}
    assert get(9, 4) == {3: True}  # 1 and 2 are archived by then and were never indexed
    assert get(0, 2) == {7: True, 8: False, 1: True} and get(2, 4) == {7: True, 8: False, 3: True}


def test_remote_batches(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(50)], "id long, text string").coalesce(1)
    got = {r.id: r.vector for r in retrieval.embedded_remotely(df, lambda texts: [[float(len(t)), float(len(texts))] for t in texts]).collect()}
    assert got[3] is None and all(got[i][0] == i and got[i][1] <= retrieval.REQUEST for i in got if i != 3)


def test_promotion_keeps_the_old_on_failure(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    store.promoted(spark.range(5), path)
    seen = iter([1, 2])
    monkeypatch.setattr(store, "fingerprint", lambda df: df.limit(0).agg(F.lit(next(seen)).alias("x")))
    with pytest.raises(ValueError):
        store.promoted(spark.range(9), path)
    assert spark.read.parquet(path).count() == 5


def test_transitions(spark):
    work = spark.createDataFrame([(1, "processing", "t", 100, None, None), (2, "terminal", None, None, None, "e"), (3, "processing", "t", 10, None, None)], "episode_id long, state string, token string, lease_until long, retry_after long, error string")
    do = lambda *c: {r.episode_id: (r.state, r.outcome) for r in queue.transitions(work, spark.createDataFrame(list(c), "episode_id long, op string, token string, at long, until long, reason string")).collect()}
    assert do((1, "fail", "t", 50, 60, "why"), (2, "retry", None, 50, None, None), (3, "renew", "t", 50, 90, None)) == {1: ("failed", "done"), 2: ("pending", "done"), 3: ("processing", "no live lease")}
    assert do((1, "fail", "t", 50, 50, "why"), (2, "terminal", "t", 1, None, "x")) == {1: ("processing", "invalid"), 2: ("terminal", "no live lease"), 3: ("processing", "-")}


def test_recovery(spark):
    parts = [("a", 0, "begin", None), ("a", 2, "text", "lo"), ("a", 1, "text", "hel"), ("a", 1, "text", "hel"), ("b", 1, "text", "x"), ("b", 1, "text", "y"), ("c", 1, "text", "z"), ("c", 2, "complete", None)]
    got = {r.message_id: (r.state, r.text, r.chunks) for r in sessions.checkpointed(spark.createDataFrame(parts, "message_id string, sequence int, kind string, text string")).collect()}
    assert got["a"] == ("interrupt", "hello", 2) and got["b"][0] == "conflict" and got["c"] == ("complete", "z", 1)
