"""Operator 11: gradients by differences, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from turnstone.llm import passage_quality as q
from turnstone.llm.passage_quality import FEATURES, Model, bags, chunk_features, held_out, learn, passages, quality_report, sampled, score

from .conftest import DOCS, clashing, words

LABELS = "doc_id long, quality int, toxic int"


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    return Model.fresh(rng.normal(0, 0.1, FEATURES), np.ones(FEATURES), 0.7)


def test_gradient_is_that_of_differences():
    rng, model = np.random.default_rng(3), small_model()
    x, owner = rng.normal(0, 1, (30, FEATURES)), np.sort(np.concatenate((np.arange(5), rng.integers(0, 5, 25))))
    y, n = np.array([1, 0, 0.3, 1, 0]), np.array([1.0, 2, 1, 0.5, 3])
    g = model.gradient(x, owner, y, n)[1]
    for i in np.concatenate((rng.integers(0, len(g), 30), np.arange(len(g) - 40, len(g)))):
        moved = [model.gradient(x, owner, y, n)[0] for model in (Model(model.shift, model.scale, model.weights + d * (np.arange(len(g)) == i)) for d in (1e-5, -1e-5))]
        assert abs((moved[0] - moved[1]) / 2e-5 - g[i]) < 1e-5 * max(1, abs(g[i]))


def test_attention_adds_up_and_order_of_passages_is_nothing():
    rng, model = np.random.default_rng(4), small_model()
    x, owner = rng.normal(0, 1, (12, FEATURES)), np.repeat([0, 1], [5, 7])
    a, _, y = model.pool(model.encode(x), owner, 2)
    assert np.allclose(np.bincount(owner, a), 1)
    order = np.concatenate((rng.permutation(5), 5 + rng.permutation(7)))
    assert np.allclose(model.pool(model.encode(x[order]), owner, 2)[2], y)


def brute_features(text):
    """Pairs of kinds and words of a text of one passage."""
    kinds = [int(q._kind_table()[ord(c)]) for c in text]
    pairs = np.zeros((len(q._KINDS),) * 2)
    for a, b in zip(kinds, kinds[1:], strict=False):
        pairs[a, b] += 1
    w = text.split()
    n = [len(x) for x in w]
    again = [sum(a == b for a, b in zip(w, w[k:], strict=False)) / len(w) for k in (1, 2)]
    return [*np.sqrt(pairs / len(text)).ravel(), np.log1p(len(w)) / 4, np.log1p(np.mean(n)) / 2, np.log1p(np.std(n)) / 2, len(set(w)) / len(w), *again, max(map(w.count, w)) / len(w), np.log1p(len(text)) / 8]


@pytest.mark.parametrize("text", ["a", "One two two, two! $$ % 12\n| x y x É 漢字", " the the  the\tthe\n", "x " * 60])
def test_features(text):
    assert np.allclose(chunk_features(text), [brute_features(text)], atol=1e-5)


def test_passages_of_odd_texts():
    assert [len(chunk_features(t)) for t in ("", " ", "\n" * 3000, "x" * 3000, "w " * 640, "w " * 641)] == [1, 1, 3, 3, 10, 11]
    long = "word " * 200_000
    rows = np.concatenate(list(passages(long)))
    assert np.isfinite(rows).all() and len(rows) >= 200_000 / q.PASSAGE_WORDS
    parts = list(bags(["a b", "", long, "c"]))
    assert [(a, b) for a, b, *_ in parts] == [(0, 2), (2, 3), (3, 4)]
    assert not chunk_features("").any() and np.isfinite(chunk_features("\ud800 lone surrogate")).all()


def corpus(n, seed=1):
    """Good texts of words; in bad ones some passages shout, repeat or are full of signs."""
    rng, out = random.Random(seed), []
    for i in range(n):
        parts, bad = [words(rng, rng.randint(20, 64)) for _ in range(rng.randint(1, 6))], i % 4 == 0
        if bad:
            k = rng.randrange(len(parts))
            w = parts[k].split()
            parts[k] = rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * len(w)), " ".join(x + "$$$" for x in w), " | ".join(w)])
        out.append((i, "\n".join(parts), None, None, None, 0 if bad else 1))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(700)
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows], LABELS)
    got = quality_report(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.schema["predicted"].dataType.simpleString() == "int"
    got = got.collect()
    assert len(got) == 700 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == rows[r.doc_id][5] for r in held]) > 0.93
    # what is held out isn't learned from
    other = spark.createDataFrame([(r[0], r[5] if zlib.crc32(str(r[0]).encode()) % 5 else 1 - r[5], 0) for r in rows], LABELS)
    assert sorted(quality_report(docs, other).collect()) == sorted(got)


def test_sample_is_bounded_and_stands_for_all(spark):
    rows = corpus(400)
    copies = [(1000 + i, rows[0][1], None, None, None) for i in range(300)]  # of a bad text
    docs = spark.createDataFrame([r[:5] for r in rows] + copies + copies[:50], DOCS)
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows] + [(1000 + i, i % 2, 0) for i in range(300)] + [(None, 1, 1), (5, None, 1)], LABELS)
    got = sampled(docs, labels, 60).collect()
    assert len({r.text for r in got}) == len(got) and 80 < len(got) < 170
    assert abs(sum(r.counts for r in got) - 400) < 120
    whole = {r.text: r for r in sampled(docs, labels, 10**6).collect()}
    assert len(whole) == 400 and {r.counts for r in whole.values()} == {1.0} and abs(whole[rows[0][1]].label - 175 / 351) < 1e-9


def test_odd_rows(spark, docs, texts, empty_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))] * 2, LABELS)
    model = learn(docs, labels, steps=3)
    got = score(docs, model).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(texts[r.doc_id] or "", set()).add(round(r.score, 9))
    assert all(len(s) == 1 for s in by_text.values())
    assert sorted(score(clashing(docs), model, keep=("lang",)).select("doc_id", "score").collect()) == sorted(score(docs, model).collect())
    assert score(empty_docs, model).collect() == [] and learn(empty_docs, labels) is None and learn(docs, labels.limit(0)) is None
    assert {(r.score, r.predicted) for r in quality_report(docs, labels.limit(0)).collect()} == {(0.5, 1)}
    one = learn(docs, labels.withColumn("quality", F.lit(1)), steps=3)
    assert min(r.score for r in score(docs, one).collect()) > 0.5
    assert docs.limit(1).select(F.lit(None).cast("long").alias("doc_id")).select(held_out()).first()[0] is False
