"""Operators 12 and 13 against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from turnstone.llm import merkle
from turnstone.llm.filter_audit import filter_audit
from turnstone.llm.merkle import indexed, manifest_report

from .conftest import DOCS, clashing

# -- 12 -----------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, i):
    """(before, after) for each level of a tree."""
    out = []
    for level in tree[:-1]:
        first = i // 3 * 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def brute_manifest(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        parts[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in parts[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, h, r) in enumerate(parts[s]):
            steps = way(trees[s], i) + way(top, k)
            cut = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            found = leaf(r, r.text.replace("\n", "")) if cut else h
            for before, after in steps:
                found = H(*before, found, *after)
            root = top[-1][0]
            out.append((r.doc_id, h, trees[s][-1][0], root, H(*(x for b, a in steps for x in b + a)), found, found == root))
    return out


def same_manifest(docs):
    got = manifest_report(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got, want = sorted(got.collect(), key=repr), sorted(brute_manifest(docs.collect()), key=repr)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return got


def test_manifest(docs):
    rows = same_manifest(docs)
    assert 0 < sum(r.verified for r in rows) < len(rows)


def test_manifest_nulls_ties_and_clashes(spark):
    rows = [(None, "a\nb", None, "x", 1), (None, "a\nb", None, "x", 1), (None, None, None, None, None), (3, "", "en", "", 0), (3, "", "en", "", 0), (3, "other", "en", "", None), (4, "é\n\n", "fr", "é", -7)]
    docs = spark.createDataFrame(rows, DOCS)
    same_manifest(docs)
    same_manifest(clashing(docs).withColumn("idx", F.lit(1)).withColumn("tree", F.lit(2)))
    assert manifest_report(docs.limit(0)).collect() == []
    same_manifest(docs.where("doc_id = 4"))  # a lone leaf of a lone part is the root


@pytest.mark.parametrize("n", [3, 10, 28, 244])
def test_manifest_of_every_height(spark, n):
    """One part of n, beside parts of other heights and very many equal rows."""
    rng = random.Random(n)
    rows = [(i, f"text {rng.random()}\n", "en", "big", i) for i in range(n)] + [(7, "same", None, "copies", 1)] * (n // 2 + 1) + [(n + 1, "one", None, "single", 1)]
    same_manifest(spark.createDataFrame(rows, DOCS).repartition(3))


def test_parts_of_one_row_each(spark):
    same_manifest(spark.createDataFrame([(i, f"t{i}", None, f"part {i * 37 % 100}", 1) for i in range(100)], DOCS))


def test_equal_rows_have_a_place_each(spark):
    rows = spark.range(6_000).select(F.lit("hot").alias("tree"), F.lit(1).alias("doc_id"))
    out = indexed(rows, "tree", ["doc_id"]).collect()
    assert sorted(r.idx for r in out) == list(range(6_000)) and {r.n for r in out} == {6_000}


def test_height():
    assert 3**merkle.MOST_LEVELS > 2**63


# -- 13 -----------------------------------------------------------------------


def fails(text, earlier):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": earlier,
    }


def brute_audit(rows, labels):
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    parts = {}
    for r in rows:
        f = fails(r.text or "", r.doc_id is not None and r.doc_id > first[r.text or ""])
        good = any(i == r.doc_id and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == r.doc_id and t == 1 for i, _, t in labels if i is not None)
        parts.setdefault(r.source or "", []).append((f, good, toxic))
    out = []
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in map("".join, permutations("ABCDE")):
            here = docs
            for k, x in enumerate(order):
                lost = [d for d in here if d[0][x]]
                here = [d for d in here if not d[0][x]]
                failing = sum(d[0][x] for d in docs)
                shapley[x] += len(lost)
                steps.append((part, order, k + 1, len(here), len(lost), failing - len(lost), sum(d[0][x] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in lost), sum(d[2] for d in lost)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return out


LABELS = "doc_id long, quality int, toxic int"


def test_audit(spark, docs):
    rows = docs.collect()
    labels = [(r.doc_id, k % 2, k % 3 == 0 and 1) for k, r in enumerate(rows) if k % 4] + [(0, 0, 1), (0, 1, 0), (1, None, None), (None, 1, 1), (10**9, 1, 1)]
    labels = [(i, q, None if t is False else t) for i, q, t in labels]
    got = filter_audit(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_audit(rows, labels))


def test_audit_edges_of_the_rules(spark):
    """Each rule at its bound, white space that is none of the six, ids that are null or repeated."""
    words = [f"w{i}" for i in range(200)]
    rows = [
        (1, " ".join(words[:49])), (2, " ".join(words[:50])), (3, " ".join(words[:65] + words[:35])), (4, " ".join(words[:64] + words[:36])), (5, "A" * 5 + "b" * 95), (6, "A" * 6 + "b" * 94),
        (7, "É" * 100), (8, "a|b"), (9, "a b c "), (9, "same"), (9, "same"), (10, "same"), (None, "same"), (None, None), (11, ""), (12, None), (13, "x\x0by\x0cz\r\t1"),
    ]
    docs = spark.createDataFrame([(i, t, None, ["p", "q"][k % 2] if k % 5 else None, None) for k, (i, t) in enumerate(rows)], DOCS)
    labels = spark.createDataFrame([(i, 1, 1) for i in range(1, 14)] * 2, LABELS)
    got = filter_audit(clashing(docs), clashing(labels))
    assert sorted(map(tuple, got.collect())) == sorted(brute_audit(docs.collect(), [(i, 1, 1) for i in range(1, 14)]))


def test_audit_of_nothing(spark, docs, empty_docs):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit(empty_docs, none).collect() == []
    rows = filter_audit(docs, none).collect()
    assert len(rows) == 600 * 3 and not any(r.good_lost or r.toxic_lost for r in rows)
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
