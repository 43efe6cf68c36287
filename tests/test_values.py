"""Values worked out by hand, invariants, and edge cases of the operators."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from turnstone.functions import temporal as tl
from turnstone.functions.text import jaccard_per_mille, lexical_score, lexical_terms, substring_count
from turnstone.functions.vector import cosine, fused
from turnstone.operators import archive, candidates, chronos, clustering, communities, entities, graph, lexical, lifecycle, reconcile, timeline, vectors
from turnstone.sources import jsonl


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_terms_and_scores(spark):
    assert one(spark, lexical_terms(F.lit("Alpha, beta alpha!"))) == ["alpha", "beta"]
    assert one(spark, substring_count(F.lit("aaaa concat cat"), F.lit("aa"))) == 2
    assert one(spark, substring_count(F.lit("concat cat"), F.lit("cat"))) == 2
    docs = spark.createDataFrame([(1, "alpha alpha alpha")], "id int, t string")
    asked = spark.createDataFrame([(0, ["alpha", "beta"])], "query_id int, terms array<string>")
    for hits in (lexical.scored(lexical.postings(docs, ["id"], "t"), asked, ["id"]), lexical.searched(docs, asked, ["id"], "t")):
        assert hits.first().score == pytest.approx(0.5375)
    assert one(spark, lexical_score(F.lit(2), F.lit(8), F.lit(2))) == pytest.approx(1.0)


def test_fusion_and_cosine(spark):
    for a, b, want in ((0.8, 0.0, 0.8), (0.0, 0.9, 0.9), (0.8, 0.6, 0.69), (0.0, 0.0, 0.0)):
        assert one(spark, fused(F.lit(a), F.lit(b))) == pytest.approx(want)
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, cosine(arr(1.0, 0.0), arr(0.8, 0.6))) == pytest.approx(0.8)
    for bad in (arr(0.0, 0.0), arr(1.0), arr(float("nan"), 1.0), F.lit(None).cast("array<double>")):
        assert one(spark, cosine(arr(1.0, 0.0), bad)) is None
    assert one(spark, jaccard_per_mille(arr(1, 2, 3, 4), arr(1, 2, 3, 4, 5))) == 800


def test_diversification(spark):
    hits = spark.createDataFrame([(0, "a", 1, 0, 8, 0.95), (0, "b", 1, 2, 10, 0.90), (0, "c", 2, 0, 8, 0.80)], "query_id int, id string, conversation_id int, start int, end int, score double")
    assert [r.id for r in vectors.diversified(hits, 3).orderBy("pick").collect()] == ["a", "c", "b"]


def test_version_cut(spark):
    log = spark.createDataFrame([(1, 100), (2, 300), (3, 200), (5, 10)], "version long, us long")
    asked = spark.createDataFrame([(t,) for t in (99, 100, 250, 299, 300)], "at long")
    got = {r.at: r.version for r in timeline.versions_at(log, asked, "version", "us").collect()}
    assert got == {99: None, 100: 1, 250: 1, 299: 1, 300: 3}
    for present, want in (([1, 2, 3], 4), ([2, 3], 1), ([1, 2, 4], 3), ([], 1), (list(range(1, 205)), 205), ([*range(1, 101), 202], 101)):
        df = spark.createDataFrame([(x,) for x in present], "version long")
        assert timeline.first_gap(df, "version", chunk=100).first().missing == want


def test_paths_of_a_deep_tree(spark):
    n = 40
    nodes = spark.createDataFrame([(1, f"n{i}", f"n{i - 1}" if i else None, i) for i in range(n)] + [(2, "x", "gone", 0), (3, "p", "q", 0), (3, "q", "p", 1)], "conversation_id int, id string, parent_id string, timestamp_ns int")
    p = archive.paths(nodes, archive.leaves(nodes).select("conversation_id", F.col("id").alias("leaf"))).where("conversation_id = 1").collect()
    assert {(r.id, r.back) for r in p} == {(f"n{i}", n - 1 - i) for i in range(n)}
    d = {r.id: r.depth for r in archive.depths(nodes).collect()}
    assert d == {f"n{i}": i for i in range(n)}  # orphans and cycles have no depth


def test_windows_and_packing(spark):
    lengths = spark.createDataFrame([("a", 20), ("b", 8), ("c", 3), ("d", 0), ("e", 14)], "k string, length long")
    got = {}
    for r in archive.windows(lengths, ["k"]).collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {"a": [(0, 8), (6, 14), (12, 20)], "b": [(0, 8)], "c": [(0, 3)], "e": [(0, 8), (6, 14)]}
    cycles = spark.createDataFrame([("a", i, i, i + 1, b) for i, b in enumerate([10, 10, 25, 5, 40, 1])], "k string, cycle int, start long, end long, bytes long")
    assert [(r.start, r.end, r.bytes) for r in archive.packed_episodes(cycles, "k", 30).orderBy("episode").collect()] == [(0, 2, 20), (2, 4, 30), (4, 5, 40), (5, 6, 1)]


@pytest.mark.parametrize(
    ("text", "reference", "want"),
    [
        ("since May", "2026-08-24", ("boundary", "2026-05-01", None)),
        ("until Friday", "2026-08-24", ("boundary", None, "2026-08-29")),
        ("after 2026-10-01", "2026-08-24", ("boundary", "2026-10-02", None)),
        ("before 2026-12-01", "2026-08-24", ("boundary", None, "2026-12-01")),
        ("from November to February", "2026-09-15", ("anchor", "2026-11-01", "2027-03-01")),
        ("three mnoths ago", "2026-08-24", ("anchor", "2026-05-24", "2026-05-25")),
        ("next Wendesday", "2026-08-24", ("anchor", "2026-08-26", "2026-08-27")),
        ("one month ago", "2024-03-31", ("anchor", "2024-02-29", "2024-03-01")),
        ("in Q1 2026", None, ("anchor", "2026-01-01", "2026-04-01")),
        ("2026-03-01 to 2026-03-05", None, ("anchor", "2026-03-01", "2026-03-06")),
        ("the 3rd of June 2025", None, ("anchor", "2025-06-03", "2025-06-04")),
        ("last week", "2026-08-24", ("anchor", "2026-08-17", "2026-08-24")),
        ("southern summer 2024", None, ("anchor", "2024-12-01", "2025-03-01")),
        ("three months ago", None, ("unresolved", None, None)),
    ],
)
def test_temporal(text, reference, want):
    ns = reference and tl.ns(date.fromisoformat(reference))
    day = lambda x: None if x is None else str(date(1970, 1, 1) + timedelta(x // tl.DAY))
    f, *copies = tl.parse(f"é {text}.", ns)
    assert [(c.kind, c.start_ns, c.end_ns) for c in copies] == [("interval", f.start_ns, f.end_ns)] * (f.granularity == "range")  # a range is an interval too
    assert (f.kind, day(f.start_ns), day(f.end_ns)) == want
    assert f"é {text}.".encode()[f.start : f.end].decode() == f.evidence and f.evidence in text


def test_temporal_odd_texts():
    assert tl.parse(None) == [] and tl.parse("") == [] and tl.parse("May I march on?", 0) == []
    assert tl.parse("on 2024-02-30 or 2024-13-01", 0) == []
    assert tl.distance("wendesday", "wednesday") == 1 and tl.distance("abc", "") == 3
    assert [(f.kind, f.value) for f in tl.parse("every other Friday at 5 pm for 2 hours")] == [("recurrence", "week:2:friday"), ("time", "17:00"), ("duration", "exact:2")]


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(1)
    make = lambda n, o: [(o + i, s, s + rng.choice([1, tl.DAY, 7 * tl.DAY, 300 * tl.DAY, 40_000 * tl.DAY]), rng.choice(["day", "range"])) for i, s in ((i, rng.randrange(-20_000, 20_000) * tl.DAY // 7) for i in range(n))]
    a, b = make(60, 0), make(60, 100)
    b += [(300 + i, *x[1:]) for i, x in enumerate(a[:20])]
    form = "id int, start_ns long, end_ns long, granularity string"
    got = sorted(tuple(r) for r in chronos.overlapping(spark.createDataFrame(a, form), spark.createDataFrame(b, form)).collect())
    score = lambda x, y: chronos.EQUAL[x[3]] if x[1:] == y[1:] else 0.75
    assert got == sorted((x[0], y[0], score(x, y)) for x in a for y in b if x[1] < y[2] and y[1] < x[2])


def test_lineage(spark):
    gen = lambda **c: spark.createDataFrame([(k, n) for k, ns in c.items() for n in ns], "community string, node int")
    r = communities.lineage(gen(a=[1, 2, 3, 4]), gen(b=[1, 2, 3, 4, 5])).first()
    assert r.continuation and r.jaccard == 800
    tied = communities.lineage(gen(a=[1, 2, 3, 4]), gen(b=[1, 2], c=[3, 4])).collect()
    assert not any(x.continuation for x in tied) and all(x.split for x in tied)


def test_communities_cover_and_gain(spark):
    rng = random.Random(2)
    edges = [(64 * c + i, 64 * c + (i + d) % 64) for c in range(6) for i in range(64) for d in (1, 2, 3, 4)] + [(64 * c, 64 * (c + 1) % 384 + rng.randrange(5)) for c in range(6)]
    e = spark.createDataFrame(edges, "a long, b long")
    home = clustering.scan_and_merge(e, shard=96)[0]
    rows = home.collect()
    assert sorted(r.node for r in rows) == list(range(384)) and all(r.community <= r.node for r in rows)
    pairs = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    planted = spark.createDataFrame([(i, i // 64) for i in range(384)], "node long, community int")
    q = [communities.modularity(pairs, h).first().modularity for h in (home, planted)]
    assert q[0] > 0.9 * q[1] > 0.5


def test_graph_walks(spark):
    edges = spark.createDataFrame([("a", "cross", 1), ("a", "local", 1), ("local", "deep", 1)], "source string, target string, kind int")
    seeds = spark.createDataFrame([(0, "a", 1)], "query_id int, node string, place int")
    homes = spark.createDataFrame([("a", 1), ("local", 1), ("deep", 1), ("cross", 2)], "node string, community int")
    routed = [r.node for r in graph.expansion(edges, seeds, homes, 4, 3).orderBy("place").collect()]
    assert routed == ["a", "local", "cross", "deep"]
    flat = [r.node for r in graph.expansion(edges, seeds, homes.withColumn("community", F.lit(1)), 4, 3).orderBy("place").collect()]
    assert flat == ["a", "cross", "local", "deep"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(chain).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_replicas(spark):
    log = lambda s: spark.createDataFrame([("k", i, c) for i, c in enumerate(s)], "k string, position int, digest string")
    for a, b, want in (("abc", "abc", "identical"), ("abcd", "abc", "left extends"), ("ab", "abc", "right extends"), ("abx", "aby", "diverged")):
        assert reconcile.compared(log(a), log(b), ["k"], "position", "digest").first().verdict == want


def test_exact_claims_of_many(spark):
    names = spark.createDataFrame([(i, f"n{i}", "k" if i < 40 else "other") for i in range(42)], "id long, name string, kind string")
    claims = spark.createDataFrame([(i, "same") for i in range(42)], "id long, claim string")
    got = sorted(tuple(r) for r in entities.block_pairs(names, claims).collect())
    assert got == sorted([(a, b, 65535) for b in range(40) for a in range(b)] + [(40, 41, 65535)])


def test_entities(spark):
    keys = lambda s: one(spark, entities.alias_keys(F.lit(s)))
    assert keys("Engine repo") == ["repository:engine"] and keys("https://host/org/Engine.git") == ["repository:engine"] and keys("NPCs") == ["acronym:npc"] and keys("plain") == []
    p = spark.createDataFrame([(0.96, 0.5, True, False), (0.94, 0.1, True, True), (0.95, 0.84, True, True), (0.99, 0.0, False, False)], "p double, second double, exact boolean, normalized boolean")
    assert [r.accepted for r in entities.decided(p).collect()] == [True, False, False, False]


def test_candidates_reserve_places_for_priors(spark):
    lane = lambda rows: spark.createDataFrame(rows, "source int, candidate int, score double")
    lanes = {"semantic": lane([(0, i, 1.0 - i / 100) for i in range(1, 40)]), "prior": lane([(0, i, 0.1 if i in (30, 31) else None) for i in range(1, 40)])}
    got = candidates.fused_candidates(lanes).collect()
    assert len(got) == 12 and {30, 31} <= {r.candidate for r in got}


def test_a_near_vector_without_a_common_word_is_a_candidate(spark):
    lane = lambda rows: spark.createDataFrame(rows, "source int, candidate int, score double")
    texts = spark.createDataFrame([(0, "the red house"), *((i, f"the house {i}") for i in range(1, 60)), (99, "ganz anders")], "id int, text string")
    overlap = candidates.token_overlap(texts.where("id = 0"), texts).withColumnRenamed("jaccard", "score")
    assert overlap.count() == 59  # however common its words are
    got = candidates.fused_candidates({"lexical": overlap, "semantic": lane([(0, 99, 0.99), (0, 5, 0.1)])}).orderBy("place").collect()
    assert got[0].candidate == 5 and got[1].candidate == 99 and len(got) == 12


def test_eligibility(spark):
    day = lifecycle.DAY
    rows = [("extracted", 0, 0, 0), ("knowledge", 29 * day, 0, 0), ("knowledge", 30 * day, 0, 29 * day), ("knowledge", 30 * day, None, day), ("knowledge", 31 * day, None, day), ("knowledge", 1, None, None)]
    df = spark.createDataFrame(rows, "state string, now long, source long, processed long")
    assert [r.due for r in df.select(lifecycle.eligible(*map(F.col, ("state", "now", "source", "processed"))).alias("due")).collect()] == [True, False, True, False, True, True]


def test_sources(spark, tmp_path):
    lines = ['{"kind":"node","id":"n","conversation_id":"c","role":"user","timestamp_ns":1,"content":"x"}', '{"kind":"branch","id":"b","conversation_id":"c","leaf_node_id":"n","canonical":true}', '{"kind":"other"}', "no json", ""]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    g = jsonl.read_graph(spark, str(tmp_path / "g.jsonl"))
    assert {k: v.count() for k, v in g.items()} == {"node": 1, "branch": 1, "echo": 0, "rejected": 2}
    jsonl.save_store({"node": g["node"]}, str(tmp_path / "store"))
    jsonl.save_store({"node": g["node"]}, str(tmp_path / "store"))
    assert jsonl.load_store(spark, str(tmp_path / "store"), ["node"])["node"].count() == 2
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("same")
    assert jsonl.read_files(spark, str(tmp_path / "*.txt")).count() == 1


def test_truncation_keeps_characters_whole(spark):
    from turnstone.operators.records import truncated

    text = "aé漢😀b"
    for n in range(13):
        want = text.encode()[:n].decode(errors="ignore")
        assert one(spark, truncated(F.lit(text), n)) == want
