"""Queries of the lexical search family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions.text import lexical_terms
from ..operators.archive import range_text, windows
from ..operators.lexical import extended, postings, scored, searched, searched_batch, top
from .tables import TURNS_SQL, turns

TERMS = ["the", "and", "die"]
_TOKENS = "list_distinct(list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda t: lower(t)))"


def _asked(spark: SparkSession, terms: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(0, terms or TERMS)], "query_id int, terms array<string>")


def _score_sql(docs: str, key: str, text: str, terms: list[str]) -> str:
    """DuckDB: hits AS (key, score) of docs by terms."""
    n, wanted = len(terms), ", ".join(f"'{t}'" for t in terms)
    return f"""posted AS (
        SELECT {key}, lower({text}) AS low, unnest({_TOKENS.format(text)}) AS term FROM {docs}
    ), counted AS (
        SELECT {key}, term, (length(low) - length(replace(low, term, ''))) // length(term) AS frequency FROM posted
        WHERE term IN ({wanted})
    ), hits AS (
        SELECT {key}, CAST(0.85 AS DOUBLE) * count(*) / {n}
               + CAST(0.15 AS DOUBLE) * least(1, sum(least(frequency, 4)) / CAST({2 * n} AS DOUBLE)) AS score
        FROM counted GROUP BY {key}
    )"""


@query("archive_search", f"""
    WITH {TURNS_SQL}, {_score_sql("turns", "id", "content", TERMS)}
    SELECT h.id, t.conversation_id, t.role, t.content, round(h.score, 9) AS score,
           row_number() OVER (ORDER BY h.score DESC, t.timestamp_ns DESC, h.id) AS rank
    FROM hits h JOIN turns t USING (id) QUALIFY rank <= 10""")
def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 turns that match best; text is joined to the winners only."""
    t = turns(spark, sf_dir)
    hits = searched(t, _asked(spark), ["id", "timestamp_ns"], "content")
    best = top(hits, [F.desc("score"), F.desc("timestamp_ns"), F.col("id")], 10)
    out = t.join(F.broadcast(best.select("id", "score", "rank")), "id")  # 10 rows
    return out.select("id", "conversation_id", "role", "content", F.round("score", 9).alias("score"), "rank")


@query("memory_search", f"""
    WITH docs AS (SELECT doc_id, coalesce(source, '') || chr(10) || chr(10) || coalesce(text, '') AS body FROM documents),
    {_score_sql("docs", "doc_id", "body", ["that", "is", "src1"])}
    SELECT doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM hits QUALIFY rank <= 10""")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and content searched as one text."""
    d = table(spark, sf_dir, "documents")
    body = d.select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("body"))
    hits = searched(body, _asked(spark, ["that", "is", "src1"]), ["doc_id"], "body")
    return top(hits, [F.desc("score"), F.col("doc_id")], 10).select("doc_id", F.round("score", 9).alias("score"), "rank")


@query("file_search", f"""
    WITH {_score_sql("pages", "page_id, url", "url", ["https", "com", "p1"])}
    SELECT page_id, url, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, url, page_id) AS rank FROM hits QUALIFY rank <= 10""")
def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their name."""
    p = table(spark, sf_dir, "pages")
    hits = searched(p, _asked(spark, ["https", "com", "p1"]), ["page_id", "url"], "url")
    return top(hits, [F.desc("score"), F.col("url"), F.col("page_id")], 10).select("page_id", "url", F.round("score", 9).alias("score"), "rank")


@query("term_postings", f"""
    WITH {TURNS_SQL}, p AS (SELECT id, lower(content) AS low, unnest({_TOKENS.format("content")}) AS term FROM turns),
    c AS (SELECT id, term, (length(low) - length(replace(low, term, ''))) // length(term) AS frequency FROM p)
    SELECT term, count(*) AS docs, CAST(sum(frequency) AS BIGINT) AS total, max(frequency) AS most FROM c GROUP BY term""")
def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds for each term."""
    index = postings(turns(spark, sf_dir), ["id"], "content")
    return index.groupBy("term").agg(F.count("*").alias("docs"), F.sum("frequency").alias("total"), F.max("frequency").alias("most"))


@query("index_extend", f"""
    WITH {TURNS_SQL} SELECT id, count(*) AS terms
    FROM (SELECT id, unnest({_TOKENS.format("content")}) AS term FROM turns WHERE turn >= 4) GROUP BY id""")
def index_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only turns that the index lacks are indexed: it was built from the first four."""
    t = turns(spark, sf_dir)
    old = postings(t.where(F.col("turn") < 4), ["id"], "content")
    return extended(old, t, ["id"], "content").groupBy("id").agg(F.count("*").alias("terms"))


@query("batch_search", f"""
    WITH q AS (SELECT item_id, {_TOKENS.format("text")} AS terms FROM benchmark),
    a AS (SELECT item_id, len(terms) AS n, unnest(terms) AS term FROM q),
    {TURNS_SQL}, p AS (SELECT id, lower(content) AS low, unnest({_TOKENS.format("content")}) AS term FROM turns),
    c AS (SELECT id, term, (length(low) - length(replace(low, term, ''))) // length(term) AS frequency FROM p),
    h AS (SELECT item_id AS query_id, id, CAST(0.85 AS DOUBLE) * count(*) / n
                 + CAST(0.15 AS DOUBLE) * least(1, sum(least(frequency, 4)) / CAST(2 * n AS DOUBLE)) AS score
          FROM a JOIN c USING (term) GROUP BY item_id, id, n)
    SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
    FROM h QUALIFY rank <= 5""")
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of queries in one plan: every benchmark passage against all turns."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), lexical_terms(F.col("text")).alias("terms"))
    hits = searched_batch(turns(spark, sf_dir), asked, ["id"], "content").withColumn("score", F.round("score", 9))
    return top(hits, [F.desc("score"), F.col("id")], 5).select("query_id", "id", "score", "rank")


@query("filtered_evidence", f"""
    WITH {TURNS_SQL}, {_score_sql("turns", "id", "content", TERMS)},
    best AS (SELECT h.id, t.conversation_id, h.score, row_number() OVER (ORDER BY h.score DESC, t.timestamp_ns DESC, h.id) AS place
             FROM hits h JOIN turns t USING (id) QUALIFY place <= 40)
    SELECT id, conversation_id, round(score, 9) AS score, place FROM best WHERE conversation_id % 2 = 0 ORDER BY place LIMIT 10""")
def filtered_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four times as many hits as asked for are taken before a filter by conversation, then the first 10."""
    t = turns(spark, sf_dir)
    key = ["id", "conversation_id", "timestamp_ns"]
    hits = searched(t, _asked(spark), key, "content")
    best = top(hits, [F.desc("score"), F.desc("timestamp_ns"), F.col("id")], 40).withColumnRenamed("rank", "place")
    kept = best.where(F.col("conversation_id") % 2 == 0).orderBy("place").limit(10)
    return kept.select("id", "conversation_id", F.round("score", 9).alias("score"), "place")


@query("fragment_search", f"""
    WITH {TURNS_SQL}, n AS (SELECT conversation_id, count(*) AS length FROM turns GROUP BY 1), w AS (SELECT conversation_id, unnest(range(0, length - 3, 2)) AS start FROM n WHERE length >= 4),
    f AS (SELECT w.conversation_id || ':' || start AS id, w.conversation_id * 8 + start AS version, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS text FROM w JOIN turns t ON t.conversation_id = w.conversation_id AND turn >= start AND turn < start + 4 GROUP BY ALL),
    {_score_sql("f", "id, version", "text", TERMS)}
    SELECT id, version, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, version DESC, id) AS rank FROM hits QUALIFY rank <= 20""")
def fragment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four turns by an index of postings: best first, then the later version."""
    t = turns(spark, sf_dir)
    length = t.groupBy("conversation_id").agg(F.count("*").alias("length"))
    ranges = windows(length, ["conversation_id"], 4, 2, tail=False)
    text = range_text(t.withColumnRenamed("turn", "position"), ranges, ["conversation_id"])
    f = text.select(F.concat_ws(":", "conversation_id", "start").alias("id"), (F.col("conversation_id") * 8 + F.col("start")).alias("version"), "text")
    hits = scored(postings(f, ["id", "version"], "text"), _asked(spark), ["id", "version"]).withColumn("score", F.round("score", 9))
    return top(hits, [F.desc("score"), F.desc("version"), F.col("id")], 20).select("id", "version", "score", "rank")
