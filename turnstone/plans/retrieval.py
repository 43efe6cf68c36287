"""Queries of retrieval: branches, sessions, the statements' index, routing, packed vectors, generations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import layout as l
from ..operators import retrieval as r
from ..operators import vectors as v
from ..operators.lexical import top
from ..operators.records import embedded
from ..session import scratch
from .communities import _ROUTE_SQL, _centroids
from .lexical import _TOKENS
from .tables import TURNS_SQL, turns
from .vectors import _COS, _query, _vectors

_TERMS = ["the", "and", "die"]
_WINDOWS_SQL = f"""{TURNS_SQL}, n AS (SELECT conversation_id AS leaf, count(*) AS length FROM turns GROUP BY 1),
    w AS (SELECT leaf, unnest(range(0, length - 3, 2)) AS start, length FROM n WHERE length >= 4),
    r AS (SELECT leaf, start, start + 4 AS "end" FROM w UNION SELECT leaf, greatest(0, length - 4), length FROM n),
    f AS (SELECT r.leaf, r.start, r."end", string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS text FROM r JOIN turns t ON t.conversation_id = r.leaf AND turn >= r.start AND turn < r."end" GROUP BY ALL),
    p AS (SELECT leaf, start, "end", lower(text) AS low, unnest({_TOKENS.format("text")}) AS term FROM f),
    c AS (SELECT leaf, start, "end", term, (length(low) - length(replace(low, term, ''))) // length(term) AS k FROM p WHERE term IN ('the', 'and', 'die')),
    lex AS (SELECT leaf, start, "end", CAST(0.85 AS DOUBLE) * count(*) / 3 + CAST(0.15 AS DOUBLE) * least(1, sum(least(k, 4)) / CAST(6 AS DOUBLE)) AS score FROM c GROUP BY ALL)"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select(F.col("conversation_id").alias("leaf"), F.col("turn").alias("position"), "role", "content")
    return r.branch_windows(rows, 4, 2)


@query("branch_search", f"""WITH {_WINDOWS_SQL} SELECT leaf AS query_id, leaf, start, "end", round(score, 9) AS score, row_number() OVER (PARTITION BY leaf ORDER BY score DESC, start DESC) AS rank
    FROM lex QUALIFY rank <= 3""")
def branch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation searched by itself: the three windows of four turns that match best."""
    f = _fragments(spark, sf_dir)
    asked = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("leaf")).distinct().select(F.col("leaf").alias("query_id"), "leaf", F.array(*map(F.lit, _TERMS)).alias("terms"))
    return r.branch_search(f, asked, 3).withColumn("score", F.round("score", 9))


@query("session_search", f"""WITH {_WINDOWS_SQL}, s AS (SELECT conv_id AS leaf, count(*) % 2 = 0 AS open FROM conversations GROUP BY 1),
    q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
    sem AS (SELECT r.leaf, r.start, r."end", {_COS.format("e.embedding", "q.embedding")} AS score FROM r JOIN embeddings e ON e.vec_id = r.leaf * 4 + r.start // 2, q WHERE {_COS.format("e.embedding", "q.embedding")} > 0),
    h AS (SELECT coalesce(l.leaf, m.leaf) AS leaf, coalesce(l.start, m.start) AS start, coalesce(l."end", m."end") AS "end",
                 CASE WHEN l.score > 0 AND m.score > 0 THEN CAST(0.45 AS DOUBLE) * l.score + CAST(0.55 AS DOUBLE) * m.score ELSE coalesce(l.score, m.score) END AS score
          FROM lex l FULL JOIN sem m ON l.leaf = m.leaf AND l.start = m.start)
    SELECT leaf AS query_id, leaf, start, "end", round(score, 9) AS score, row_number() OVER (PARTITION BY leaf ORDER BY score DESC, start DESC) AS rank
    FROM h JOIN s USING (leaf) WHERE open QUALIFY rank <= 3""")
def session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with vectors, at the leaf of sessions that are open: those with an even number of turns."""
    f, e = _fragments(spark, sf_dir), _vectors(spark, sf_dir)
    sessions = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session")).agg((F.count("*") % 2 == 0).alias("open")).withColumn("leaf", F.col("session"))
    asked = sessions.select(F.col("session").alias("query_id"), "session", F.array(*map(F.lit, _TERMS)).alias("terms")).crossJoin(e.where("id = 0").select(F.col("vector").alias("query")))  # one row
    vectors = f.select("leaf", "start", (F.col("leaf") * 4 + F.expr("start div 2")).alias("id")).join(e, "id").select("leaf", "start", "vector")
    return r.branch_search(f, r.session_queries(sessions, asked), 3, vectors).withColumn("score", F.round("score", 9))


@query("memory_index_toggle", """
    WITH m AS (SELECT max(event_id) AS top FROM events), l AS (SELECT user_id AS id, event_id AS version, event_type = 'error' AS archived FROM events),
    old AS (SELECT id, NOT max_by(archived, version) AS active FROM l, m WHERE version <= top // 2 GROUP BY id HAVING NOT max_by(archived, version)),
    new AS (SELECT id, NOT max_by(archived, version) AS active FROM l, m WHERE version > top // 2 GROUP BY id)
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.active, o.active) AS active FROM old o FULL JOIN new n ON n.id = o.id WHERE o.id IS NOT NULL OR n.active""")
def memory_index_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the first half of a log, brought up to its end; and once from a version that isn't
    there any more, which must give the same as an index built anew."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("archived"))
    top = log.agg(F.max("version")).first()[0]
    none = spark.createDataFrame([], "id long, active boolean")
    half = r.index_slots(none, -1, log, top // 2)
    return r.index_slots(half, top // 2, log, top)


_INDEX_SQL = """ix AS (SELECT vec_id AS id, embedding, CASE WHEN vec_id % 13 <> 0 THEN label END AS community FROM embeddings LEFT JOIN labels ON doc_id = vec_id WHERE coalesce(toxic, 0) = 0)"""


def _index(spark: SparkSession, sf_dir: str, graph_version: int = 1) -> DataFrame:
    e, toxic = _vectors(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    memories = e.select("id").join(toxic, "id", "left").select("id", (F.coalesce("toxic", F.lit(0)) == 1).alias("archived"))
    return r.retrieval_index(memories, e, e.where("id % 13 <> 0").select("id", F.col("label").alias("community")), 1, graph_version)


@query("retrieval_index", f"WITH {_INDEX_SQL} SELECT id, community, 'current' AS snapshot FROM ix UNION ALL SELECT id, NULL, 'old' FROM ix")
def retrieval_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be retrieved, with communities if their snapshot is current."""
    of = lambda version, name: _index(spark, sf_dir, version).select("id", "community", F.lit(name).alias("snapshot"))
    return of(1, "current").union(of(2, "old"))


@query("stale_index_guard", """
    SELECT label AS owner, count(*) % 3 <> 0 OR max(vec_id) % 2 <> 0 AS stale,
           concat_ws(',', CASE WHEN count(*) % 3 <> 0 THEN 'memory_version' END, CASE WHEN max(vec_id) % 2 <> 0 THEN 'graph_version' END) AS differs FROM embeddings GROUP BY label""")
def stale_index_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as owners whose index was built at other versions than the current ones."""
    now = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("owner")).agg(F.count("*").alias("memory_version"), F.max("vec_id").alias("graph_version")).withColumns({"generation": F.lit(4), "bindings": F.lit(None).cast("int")})
    built = now.withColumns({"memory_version": F.col("memory_version") - F.col("memory_version") % 3, "graph_version": F.col("graph_version") - F.col("graph_version") % 2})
    return r.stale(built, now, ["memory_version", "graph_version", "generation", "bindings"])


_NEAR = f"{_COS.format('x.embedding', 'q.embedding')}"


@query("retrieval_fallback", f"""WITH {_ROUTE_SQL}, {_INDEX_SQL},
    a AS (SELECT q.vec_id AS query_id, x.id, round({_NEAR}, 9) AS score FROM ix x, embeddings q WHERE q.vec_id IN (0, 7, 11) AND (x.community IS NULL OR EXISTS (SELECT 1 FROM ro WHERE ro.query_id = q.vec_id AND ro.community = x.community))),
    b AS (SELECT q.vec_id AS query_id, x.id, round({_NEAR}, 9) AS score FROM ix x, embeddings q WHERE q.vec_id IN (0, 7, 11))
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, 'routed' AS mode, false AS fallback FROM a QUALIFY rank <= 4
    UNION ALL (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, 'exact', true FROM b QUALIFY rank <= 4)
    UNION ALL (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, 'exact', false FROM b QUALIFY rank <= 4)""")
def retrieval_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries routed, then without any centroids, then exactly."""
    index, asked, c = _index(spark, sf_dir), _query(spark, sf_dir, [0, 7, 11]), _centroids(spark, sf_dir)
    out = r.retrieved(index, c, asked).union(r.retrieved(index, c.limit(0), asked)).union(r.retrieved(index, c, asked, mode="exact"))
    return out.withColumn("score", F.round("score", 9))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/layout-{uuid.uuid4().hex}"
    index = _index(spark, sf_dir).select("id", "vector", "community")
    l.write_layout(index, path, parts=16, file_rows=100)
    return l.read_layout(spark, path, ", ".join(f"{n} {t}" for n, t in index.dtypes))


@query("routed_layout", f"""WITH {_ROUTE_SQL}, {_INDEX_SQL},
    a AS (SELECT q.vec_id AS query_id, x.id, round({_NEAR}, 9) AS score FROM ix x, embeddings q WHERE q.vec_id IN (0, 7, 11) AND (x.community IS NULL OR EXISTS (SELECT 1 FROM ro WHERE ro.query_id = q.vec_id AND ro.community = x.community)))
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM a QUALIFY rank <= 4""")
def routed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries over an index that lies by community: only chosen folders are read."""
    hits = l.routed_search(_layout(spark, sf_dir), _centroids(spark, sf_dir), _query(spark, sf_dir, [0, 7, 11]), parts=16)
    return hits.withColumn("score", F.round("score", 9))


@query("two_owner_retrieval", f"""
    WITH s AS (SELECT CASE WHEN c.vec_id % 2 = 0 THEN 'project' ELSE 'user' END AS owner, q.vec_id AS query_id, c.vec_id AS id, round({_COS.format("c.embedding", "q.embedding")}, 9) AS score FROM embeddings c, embeddings q WHERE q.vec_id IN (0, 7, 11))
    SELECT *, row_number() OVER (PARTITION BY owner, query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 4""")
def two_owner_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores asked the same: even vectors are the project's, odd ones the user's."""
    e, asked = _vectors(spark, sf_dir), _query(spark, sf_dir, [0, 7, 11])
    hits = {name: v.semantic_search(e.where(F.col("id") % 2 == k), asked, 4, positive=False) for name, k in (("project", 0), ("user", 1))}
    return r.of_owners(hits).withColumn("score", F.round("score", 9))


@query("weighted_hybrid", f"""
    WITH l AS (SELECT vec_id AS id, CAST(1 AS DOUBLE) / (1 + vec_id % 50) AS score FROM embeddings WHERE vec_id % 3 = 0), q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
    s AS (SELECT vec_id AS id, {_COS.format("x.embedding", "q.embedding")} AS score FROM embeddings x, q WHERE {_COS.format("x.embedding", "q.embedding")} > 0),
    h AS (SELECT coalesce(l.id, s.id) AS id, round(CASE WHEN l.score > 0 AND s.score > 0 THEN l.score * (CAST(2 AS DOUBLE) / 5) + s.score * (CAST(3 AS DOUBLE) / 5) ELSE coalesce(l.score, s.score) END, 9) AS score FROM l FULL JOIN s USING (id))
    SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= 50""")
def weighted_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lanes fused in the ratio 2 to 3; a hit of one lane keeps its score."""
    e = _vectors(spark, sf_dir)
    lex = e.where("id % 3 = 0").select(F.lit(0).cast("long").alias("query_id"), "id", (F.lit(1.0) / (1 + F.col("id") % 50)).alias("score"))
    sem = v.semantic_search(e, _query(spark, sf_dir, [0]), 1 << 30).drop("rank")
    both = v.hybrid(lex, sem, ["id"], 1 << 30, (2, 3)).withColumn("score", F.round("score", 9)).drop("rank")
    return top(both, [F.desc("score"), F.col("id")], 50).select("id", "score", "rank")


@query("packed_cosine", f"SELECT c.vec_id AS id, round({_COS.format('c.embedding', 'q.embedding')}, 9) AS score FROM embeddings c, embeddings q WHERE q.vec_id = 7")
def packed_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors packed by label into matrices of 32-bit floats, then scored row by row of these."""
    e = _vectors(spark, sf_dir)
    asked = e.where("id = 7").select("vector").first()[0]
    return r.packed_cosines(r.packed(e, "label", rows=64), asked).withColumn("score", F.round("score", 9))


@query("vector_set_check", """
    WITH s AS (SELECT label AS "set", vec_id AS id FROM embeddings UNION ALL SELECT label, vec_id * 3 FROM embeddings),
    k AS (SELECT "set", id, count(*) AS n, id IN (SELECT vec_id FROM embeddings) AS real FROM s GROUP BY 1, 2)
    SELECT "set", CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE NOT real) AS unknown,
           (SELECT count(*) FROM embeddings) - count(*) FILTER (WHERE real) AS missing FROM k GROUP BY 1""")
def vector_set_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets by label that list vectors, and three times their numbers, against all vectors."""
    e = _vectors(spark, sf_dir)
    return r.set_errors(e.select(F.col("label").alias("set"), "id").union(e.select("label", F.col("id") * 3)), e.select("id"))


@query("vector_bindings", """
    SELECT user_id AS profile, CAST(value AS BIGINT) AS body, count(DISTINCT event_type) AS sets FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1""")
def vector_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies (whole values) that a user's profile binds to several sets (types)."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("profile"), F.rint("value").cast("long").alias("body"), F.col("event_type").alias("set"))
    return r.binding_errors(ev)


@query("generation_coverage", """
    WITH t AS (SELECT conv_id * 8 + turn AS created, turn FROM conversations), n AS (SELECT max(created) AS newest, count(*) AS fragments, count(*) FILTER (WHERE turn < 3) AS few FROM t),
    g AS (SELECT unnest([1, 2, 3, 4, 5]) AS generation, unnest([newest, newest - 1, newest + 10, newest, newest]) AS source, unnest([fragments, fragments, fragments, few, fragments]) AS have, unnest([8, 8, 8, 8, 9]) AS size, * FROM n)
    SELECT CAST(generation AS INTEGER) AS generation, source AS source_version, CASE WHEN source > newest + 5 THEN 'out of range' WHEN source < newest THEN 'too old' WHEN have < fragments THEN 'missing' WHEN size <> 8 THEN 'dimensions' ELSE '' END AS problem FROM g""")
def generation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five generations of turn vectors by a stand-in model: one whole, one before the last turn, one of a
    version that doesn't exist, one that lacks turns, one of other dimensions."""
    t = turns(spark, sf_dir).select(F.col("id").alias("fragment"), (F.col("conversation_id") * 8 + F.col("turn")).alias("created"), "content", "turn")
    newest = t.agg(F.max("created")).first()[0]
    made = embedded(t, "fragment", "content", 8).withColumn("size", F.size("vector")).select("fragment", "size")
    every = lambda g: made.select(F.lit(g).alias("generation"), "fragment", "size")
    some = every(4).join(t.where("turn < 3").select("fragment"), "fragment", "left_semi")
    rows = every(1).union(every(2)).union(every(3)).union(some.select("generation", "fragment", "size")).union(every(5).withColumn("size", F.col("size") + 1))
    g = spark.createDataFrame([(1, newest, 8), (2, newest - 1, 8), (3, newest + 10, 8), (4, newest, 8), (5, newest, 8)], "generation int, source_version long, dimensions int")
    return r.coverage(g, t, rows, newest + 5).select("generation", "source_version", "problem")


@query("rebuilt_vectors", """
    SELECT d.doc_id, coalesce(round(list_sum(CAST(e.embedding AS DOUBLE[])), 3), 64 * coalesce(length(d.text), 0)) AS total, e.vec_id IS NOT NULL AS kept
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def rebuilt_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector get one from a stand-in model, sixteen texts a request; the rest keep theirs."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = _vectors(spark, sf_dir).select(F.col("id").alias("doc_id"), "vector").join(d.select("doc_id"), "doc_id", "left_semi")
    model = lambda texts: [[float(len(t))] * 64 for t in texts]
    full = r.rebuilt(d, e, "doc_id", lambda x: r.embedded_remotely(x, model, "doc_id"))
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 3)
    return full.join(e.select("doc_id", F.lit(True).alias("old")), "doc_id", "left").select("doc_id", total.alias("total"), F.coalesce("old", F.lit(False)).alias("kept"))
