"""Whole stores against each other."""

import random

import pytest
from turnstone.operators import reconcile as r

SCHEMAS = {
    "turns": "id long, content string, position long",
    "memories": "id long, revision int, mutation long, body long, position long",
    "entities": "id long, revision int, mutation long, body long, position long",
    "tombstones": "id long, replacement_id long, position long",
    "relations": "source long, target long, kind int, active boolean, position long",
    "links": "file_id long, memory_id long, position long",
}


def store(spark, log):
    """log: (table, columns...) in order."""
    rows = {t: [] for t in SCHEMAS}
    for position, (t, *values) in enumerate(log):
        rows[t].append((*values, position))
    return {t: spark.createDataFrame(x, SCHEMAS[t]) for t, x in rows.items()}


def logged(made):
    """A store as its log."""
    out = sorted((row[-1], t, *row[:-1]) for t, df in made.items() for row in df.collect())
    assert [x[0] for x in out] == list(range(len(out)))
    return [x[1:] for x in out]


COMMON = [("turns", 1, "a"), ("memories", 1, 1, 10, 0), ("entities", 1, 1, 20, 0), ("relations", 1, 2, 0, True), ("links", 5, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_common_beginning_of_logs(spark, seed):
    rng = random.Random(seed)
    for n, m, at in ((40, 40, None), (40, 30, None), (20, 33, None), (40, 40, 0), (40, 37, rng.randrange(37)), (0, 5, None), (64, 64, 63))[seed::3]:
        make = lambda k, changed: spark.createDataFrame([(i, f"d{i}" + "!" * (i == changed)) for i in range(k)], "position long, digest string")
        relation = "diverged" if at is not None else "identical" if n == m else "left extends" if n > m else "right extends"
        common = at if at is not None else min(n, m)
        if at is not None and at == 63:
            relation = "diverged"
        assert r.compared_logs(make(n, None), make(m, at), size=8) == (relation, common, n, m)


def test_what_extends_is_the_result(spark):
    longer = [*COMMON, ("turns", 2, "b")]
    a, b = store(spark, COMMON), store(spark, longer)
    for left, right, relation, change in ((a, b, "right extends", True), (b, a, "left extends", False), (b, b, "identical", False)):
        made, report, conflicts = r.reconciled_stores(left, right)
        assert (report["relation"], report["change_required"], conflicts) == (relation, change, None) and logged(made) == longer


def test_a_tail_is_put_onto_the_left_store(spark):
    left = store(spark, [*COMMON, ("turns", 2, "b"), ("relations", 1, 2, 0, False), ("tombstones", 3, 1), ("memories", 2, 1, 11, 0)])
    right = store(spark, [*COMMON, ("memories", 1, 2, 12, 0), ("turns", 2, "b"), ("turns", 3, "c"), ("relations", 1, 2, 0, False), ("relations", 1, 2, 0, True), ("entities", 3, 1, 21, 0), ("entities", 4, 1, 22, 0), ("links", 5, 1), ("links", 6, 1), ("links", 6, 1), ("entities", 7, 1, 23, 0), ("tombstones", 7, 4)])
    made, report, _ = r.reconciled_stores(left, right)
    assert logged(made)[9:] == [("turns", 3, "c"), ("memories", 1, 2, 12, 0), ("entities", 4, 1, 22, 0), ("tombstones", 7, 4), ("relations", 1, 2, 0, True), ("links", 6, 1)]
    assert report == {"relation": "diverged", "common": 5, "left_length": 9, "right_length": 17, "change_required": True, "replayed turns": 1, "duplicate turns": 1, "replayed memories": 1, "replayed entities": 1, "retired entities": 2, "replayed tombstones": 1, "replayed relations": 1, "duplicate relations": 1, "replayed links": 1, "duplicate links": 2}


def test_conflicts_make_no_store(spark):
    left = store(spark, [*COMMON, ("turns", 2, "b"), ("memories", 1, 2, 11, 0), ("relations", 1, 2, 0, False), ("entities", 1, 2, 30, 0)])
    right = store(spark, [*COMMON, ("turns", 2, "other"), ("memories", 1, 2, 12, 0), ("relations", 1, 2, 0, True), ("entities", 1, 2, 31, 0)])
    made, report, conflicts = r.reconciled_stores(left, right)
    assert made is None and report["relation"] == "diverged"
    assert sorted(map(tuple, conflicts.collect())) == [("entity_revision", "1"), ("graph_relation", "1:2:0"), ("memory_revision", "1"), ("source_turn", "2")]
