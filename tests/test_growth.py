"""What meets in joins grows with the tables, not with the square of a group: rows that are shuffled are
counted from Spark's stages."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from turnstone.functions.text import lexical_terms
from turnstone.operators import admission, blocks, candidates, chronos, lexical


def shuffled(spark, run):
    """What run() gives, and the most rows that a stage of it shuffled."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    none = jvm.java.util.ArrayList()

    def stages():
        found = store.stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
        return [found.apply(i) for i in range(found.size())]

    before = {s.stageId() for s in stages()}
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return out, max((s.shuffleWriteRecords() for s in stages() if s.stageId() not in before), default=0)


def test_conflicts_of_a_frequent_name(spark):
    n = 400
    e = spark.createDataFrame([(i, "large ring", ["ring"], "A" if i % 4 else "B") for i in range(n)], "id long, name string, aliases array<string>, kind string")
    # mention 7 comes in two rows: both its surfaces meet both its kinds
    m = spark.createDataFrame([(i, "services/large ring component", "A") for i in range(n)] + [(7, "no such thing", "B"), (n, None, "A"), (n + 1, "ring", None)], "mention long, surface string, kind string")
    rows, most = shuffled(spark, lambda: sorted(map(tuple, admission.creation_conflicts(m.repartition(3), e.repartition(3), 5).collect())))
    want = {k: [1, 2, 3, 5, 6] for k in range(n)} | {7: [0, 1, 2, 3, 4]}
    assert rows == [(k, x, place + 1) for k in range(n) for place, x in enumerate(want[k])]
    assert most < 20 * n


def test_pairs_of_frequent_and_rare_tokens(spark):
    n = 300
    words = [[f"w{j}" for j in range(40) if i % (j + 1) == 0] + [f"rare{i // 3}", "x"] for i in range(n)]
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)] + [(n, None), (n + 1, "? !")], "id long, text string").repartition(3)
    rows, most = shuffled(spark, lambda: sorted(map(tuple, candidates.token_overlap(texts.where("id % 10 = 0"), texts).collect())))
    sets = [set(w) - {"x"} for w in words]  # tokens of one byte don't count
    assert rows == [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(0, n, 10) for b in range(n) if a != b]
    assert most < 2 * n


def test_best_jaccards_with_boosts_and_weights(spark):
    rng = np.random.default_rng(1)
    sets = [sorted({f"t{int(x)}" for x in rng.zipf(1.3, 12) % 5000}) for _ in range(700)]
    kind = [None if i % 9 == 0 else f"k{i % 4}" for i in range(700)]
    rows = spark.createDataFrame([(i, s, k) for i, (s, k) in enumerate(zip(sets, kind))], "candidate long, tokens array<string>, other string").repartition(5)
    asked = rows.where("candidate % 7 = 0").withColumnsRenamed({"candidate": "source", "other": "own"})
    got = {}
    for r in blocks.best_pairs(rows, asked, blocks.jaccards("tokens", "tokens", {("own", "other"): 0.08}, digits=9), 20, block=40).collect():
        got.setdefault(r.source, []).append((-r.score, r.candidate))
    for a in range(0, 700, 7):
        of = lambda b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) + 0.08 * (kind[a] is not None and kind[a] == kind[b])  # noqa: B023, E731
        want = sorted((-math.floor(of(b) * 1e9 + 0.5) / 1e9, b) for b in range(700) if b != a and set(sets[a]) & set(sets[b]))[:20]
        assert sorted(got.get(a, [])) == want


def test_searches_of_common_terms(spark):
    words = "the of server disk the_ net full old new".split()
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(words, 8)) + f" z{i // 2}" * (i % 3) for i in range(400)]
    docs = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(texts)] + [("none", None), ("empty", "")], "turn_id string, text string").repartition(4)
    asked = docs.where("turn_id like '%7'").select(F.col("text").alias("query_id"), lexical_terms(F.col("text")).alias("terms")).distinct()
    hits = lexical.searched_batch(docs, asked, ["turn_id"], "text").withColumn("score", F.round("score", 9))
    want = sorted(map(tuple, lexical.top(hits, [F.desc("score"), F.col("turn_id")], 5).select("query_id", "turn_id", "score", "rank").collect()))
    rows, most = shuffled(spark, lambda: sorted(map(tuple, lexical.best_of_batch(docs, asked, "turn_id", "text", 5).collect())))
    assert rows == want and len({r[0] for r in rows}) == 40
    assert most < 4 * 402


def test_a_text_that_comes_again_is_parsed_once(monkeypatch):
    asked, real = [], chronos.rows
    monkeypatch.setattr(chronos, "rows", lambda *given: asked.append(given) or real(*given))
    given = [("Due 2020-01-02", 0), ("Due 2020-01-02", 0), ("two weeks ago", 10**18), ("two weeks ago", None), (None, 0), ("x" * 300 + " 2021-05", 0)]
    batch = lambda at: pa.RecordBatch.from_pydict({"id": list(range(6)), "text": [t for t, _ in given], "reference": pa.array([r for _, r in given], pa.int64())})
    out = list(chronos.remembered(iter(map(batch, range(3)))))
    want = pa.array([real(*g) for g in given], chronos._TYPE).to_pylist()
    assert [b.column("findings").to_pylist() for b in out] == [want] * 3
    assert len(asked) == 5 + 2  # the long one isn't remembered
