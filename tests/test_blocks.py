"""Best pairs by blocks, and the layout of the retrieval index."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from turnstone.operators.blocks import best_pairs, cosines
from turnstone.operators.layout import read_layout, routed_search, write_layout
from turnstone.operators.retrieval import retrieved


@pytest.mark.parametrize(("k", "block"), [(3, 2048), (40, 7)])
def test_best_pairs(spark, k, block):
    rng = np.random.default_rng(k)
    v = np.round(rng.standard_normal((300, 6)), 1)
    v[50:80] = v[20]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [0.0] * 6), (402, [1.0, None] + [0.0] * 4), (403, [1.0] * 5)]
    df = spark.createDataFrame(rows, "candidate long, v array<double>").repartition(3)
    asked = df.where("candidate % 10 = 0 and candidate < 300").withColumnRenamed("candidate", "source")
    out = spark.createDataFrame([(20, 50), (20, 51), (0, 7)], "source long, candidate long")
    got = best_pairs(df, asked, cosines("v", "v"), k, out, block=block).collect()
    norms = np.linalg.norm(v, axis=1)
    sims = np.round(v @ v.T / norms[:, None] / norms[None, :], 9)
    for s in range(0, 300, 10):
        no = {s} | {c for a, c in ((20, 50), (20, 51), (0, 7)) if a == s}
        want = sorted(((-sims[s, c], c) for c in range(300) if c not in no))[:k]
        mine = sorted((-r.score, r.candidate) for r in got if r.source == s)
        assert [c for _, c in mine] == [c for _, c in want] and np.allclose([x for x, _ in mine], [x for x, _ in want])
    assert {r.source for r in got} == set(range(0, 300, 10))
    assert best_pairs(df, asked.limit(0), cosines("v", "v"), k).collect() == []
    assert best_pairs(df.limit(0), asked, cosines("v", "v"), k).collect() == []


def test_a_routed_query_reads_its_folders_only(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 8)) * 5
    rows = [(i, (centres[i % 40] + rng.standard_normal(8)).tolist(), None if i % 97 == 0 else i % 40) for i in range(2000)]
    index = spark.createDataFrame(rows, "id long, vector array<double>, community long")
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "community long, centroid array<double>")
    queries = spark.createDataFrame([(i, (centres[i] + 0.1).tolist()) for i in (3, 17)], "query_id long, query array<double>")
    path = str(tmp_path / "index")
    write_layout(index, path, parts=32, file_rows=200)
    layout = read_layout(spark, path, "id long, vector array<double>, community long")
    assert sorted(layout.drop("part").collect()) == sorted(index.collect())
    hits = routed_search(layout, centroids, queries, seeds=5, communities=2, parts=32)
    want = retrieved(index, centroids, queries, seeds=5, communities=2).select("query_id", "id", "score", "rank")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    largest = index.groupBy("community").count().agg(F.max("count")).first()[0]
    assert largest <= 200
