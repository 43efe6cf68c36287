"""Queries of the vector family. Embeddings stand for documents with the same number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import vectors as v
from ..operators.lexical import searched, top
from .lexical import _asked, _score_sql
from .tables import TURNS_SQL, turns

_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query(spark: SparkSession, sf_dir: str, ids: list[int]) -> DataFrame:
    return _vectors(spark, sf_dir).where(F.col("id").isin(ids)).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


@query("semantic_search", f"""
    WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round({_COS.format("c.embedding", "q.embedding")}, 9) AS score
               FROM embeddings c, embeddings q WHERE q.vec_id IN (0, 7, 11))
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = v.semantic_search(_vectors(spark, sf_dir), _query(spark, sf_dir, [0, 7, 11]), 10)
    return hits.select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("memory_semantic", f"""
    WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round({_COS.format("c.embedding", "q.embedding")}, 9) AS score
               FROM embeddings c, embeddings q WHERE q.vec_id = 3 AND c.label = (SELECT (label + 1) % 10 FROM embeddings WHERE vec_id = 3))
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 400""")
def memory_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory search keeps negative scores; here among the vectors of another label."""
    q = _query(spark, sf_dir, [3])
    other = _vectors(spark, sf_dir).where("id = 3").select(((F.col("label") + 1) % 10).alias("label"))
    hits = v.semantic_search(_vectors(spark, sf_dir).join(F.broadcast(other), "label"), q, 400, positive=False)
    return hits.select("query_id", "id", F.round("score", 9).alias("score"), "rank")


_LEX = ["the", "and", "die"]
_HYBRID_SQL = f"""WITH {TURNS_SQL}, numbered AS (SELECT *, conversation_id * 8 + turn AS n FROM turns),
    {_score_sql("numbered", "n", "content", _LEX)},
    sem AS (SELECT c.vec_id AS n, {_COS.format("c.embedding", "q.embedding")} AS score FROM embeddings c, embeddings q WHERE q.vec_id = 0),
    sem_top AS (SELECT n, score FROM sem WHERE score > 0 QUALIFY row_number() OVER (ORDER BY score DESC, n) <= 30),
    lex_top AS (SELECT n, score FROM hits QUALIFY row_number() OVER (ORDER BY score DESC, n) <= 30),
    f AS (SELECT coalesce(l.n, s.n) AS n, round(CASE WHEN l.score > 0 AND s.score > 0 THEN CAST(0.45 AS DOUBLE) * l.score + CAST(0.55 AS DOUBLE) * s.score
                 ELSE coalesce(l.score, s.score, 0) END, 9) AS score FROM lex_top l FULL JOIN sem_top s USING (n))"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("n", F.col("conversation_id") * 8 + F.col("turn"))
    lex = top(searched(t, _asked(spark), ["n"], "content"), [F.desc("score"), F.col("n")], 30).drop("rank")
    sem = v.semantic_search(_vectors(spark, sf_dir).withColumnRenamed("id", "n"), _query(spark, sf_dir, [0]), 30, "n").drop("rank")
    return v.hybrid(lex, sem, ["n"], 60).withColumn("score", F.round("score", 9))


@query("hybrid_fusion", f"{_HYBRID_SQL} SELECT n, score, row_number() OVER (ORDER BY score DESC, n) AS rank FROM f QUALIFY rank <= 30")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and vectors of the same number, full outer, fused by .45 and .55."""
    h = _hybrid(spark, sf_dir).drop("rank")
    return top(h, [F.desc("score"), F.col("n")], 30).select("n", "score", "rank")


@query("diversify")
def diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten of the fused hits, each as a window of four turns of its conversation."""
    h = _hybrid(spark, sf_dir).select("query_id", F.col("n").alias("id"), F.expr("n div 8").alias("conversation_id"), (F.col("n") % 8).alias("start"), (F.col("n") % 8 + 4).alias("end"), "score")
    return v.diversified(h, 10)


@query("range_dedup", f"{_HYBRID_SQL} SELECT n, score FROM f QUALIFY row_number() OVER (PARTITION BY n // 4 ORDER BY score DESC, n) = 1")
def range_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit of each four turns, the best."""
    h = _hybrid(spark, sf_dir).withColumn("four", F.expr("n div 4"))
    return v.deduplicated(h, ["four"], "n").select("n", "score")


@query("missing_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.missing(table(spark, sf_dir, "documents"), _vectors(spark, sf_dir).withColumnRenamed("id", "doc_id"), ["doc_id"]).select("doc_id")


@query("mean_vector_per_label", """
    WITH p AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS position FROM embeddings)
    SELECT label, CAST(position AS INTEGER) AS position, round(avg(CAST(x AS DOUBLE)), 9) AS mean FROM p GROUP BY 1, 2""")
def mean_vector_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.mean_vectors(_vectors(spark, sf_dir), "label").withColumn("mean", F.round("mean", 9))


@query("medoid_per_label", f"""
    WITH s AS (SELECT a.label, a.vec_id AS id, round(sum({_COS.format("a.embedding", "b.embedding")}), 9) AS score
               FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY 1, 2)
    SELECT label, id, score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, id) = 1""")
def medoid_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.medoids(_vectors(spark, sf_dir), "label", "id")


@query("probe_min_cosine", f"""
    WITH m AS (SELECT min({_COS.format("a.embedding", "b.embedding")}) AS least FROM embeddings a
               JOIN (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 2)) AS embedding FROM embeddings) b USING (vec_id) WHERE vec_id < 4)
    SELECT round(least, 9) AS least, least + 1e-12 >= 0.9998 AS compatible FROM m""")
def probe_min_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four probes against themselves rounded to two places."""
    p = _vectors(spark, sf_dir).where("id < 4").select("id", "vector")
    fresh = p.select("id", F.transform("vector", lambda x: F.round(x.cast("double"), 2)).alias("vector"))
    return v.probe_min(p, fresh, "id").withColumn("least", F.round("least", 9))


@query("allowed_semantic", f"""
    WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round({_COS.format("c.embedding", "q.embedding")}, 9) AS score FROM embeddings c, embeddings q
               WHERE q.vec_id IN (0, 7, 11) AND c.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1))
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""")
def allowed_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only vectors of good documents may be found: the filter stands before the ranking."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    hits = v.semantic_search(_vectors(spark, sf_dir).join(good, "id", "left_semi"), _query(spark, sf_dir, [0, 7, 11]), 10)
    return hits.select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("vector_norms", """
    WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings)
    SELECT vec_id, round(norm, 6) AS norm, abs(norm - 1) <= 1e-4 AS normalised FROM n""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, and whether they are 1 within a ten-thousandth."""
    return _vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(v.norm(F.col("vector")), 6).alias("norm"), v.is_normalised(F.col("vector")).alias("normalised"))


@query("diverse_representatives", f"""
    WITH s AS (SELECT a.label, a.vec_id AS id, round(sum({_COS.format("a.embedding", "b.embedding")}), 6) AS t FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY 1, 2),
    m AS (SELECT label, id FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY t DESC, id) = 1),
    d AS (SELECT e.label, e.vec_id AS id, round({_COS.format("e.embedding", "c.embedding")}, 9) AS near FROM embeddings e JOIN m ON m.label = e.label JOIN embeddings c ON c.vec_id = m.id WHERE e.vec_id <> m.id),
    f AS (SELECT label, id FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY near, id) = 1)
    SELECT label, id, 0 AS place FROM m UNION ALL SELECT label, id, 1 FROM f""")
def diverse_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label the medoid, and what is farthest from it."""
    return v.diverse(_vectors(spark, sf_dir), "label", "id", 2)
