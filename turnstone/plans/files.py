"""Queries over files and stores that they write first: attachments, bytes, compact copies, titles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import files as f
from ..session import scratch
from ..sources import files as s
from ..sources.jsonl import load_store, save_store
from .tables import TURNS_SQL, turns


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _path(page: str = "page_id") -> str:
    return f"concat('p', {page} % 7, '/', {page}, '.html')"


#: A file's name: its parts with their lengths before them.
_ID_SQL = "sha256('file/' || octet_length(encode(content_id)) || ':' || content_id || length(CAST(byte_length AS VARCHAR)) || ':' || byte_length || octet_length(encode(filename)) || ':' || filename || octet_length(encode(coalesce(mime_type, ''))) || ':' || coalesce(mime_type, ''))"
_FILES_SQL = f"""p AS (SELECT page_id, 'p' || page_id % 7 || '/' || page_id || '.html' AS path, sha256(html) AS content_id, CAST(octet_length(encode(html)) AS BIGINT) AS byte_length FROM pages WHERE html IS NOT NULL),
    n AS (SELECT page_id, path, content_id, byte_length, page_id || '.html' AS filename, 'text/html' AS mime_type, 'o' || page_id % 20 AS owner FROM p
        UNION ALL SELECT page_id, path, content_id, byte_length, 'copy.html', NULL, 'c' FROM p WHERE page_id % 3 = 0),
    i AS (SELECT *, {_ID_SQL} AS file_id FROM n)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, bytes): the HTML of pages."""
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.expr(_path()).alias("path"), F.encode("html", "UTF-8").alias("bytes"))


def _wanted(pages: DataFrame) -> DataFrame:
    """Every page, every third once more under another name, and paths that lead nowhere for every fifth."""
    none = F.lit(None).cast("string")
    own = pages.select(F.expr("concat('o', page_id % 20)").alias("owner"), F.col("page_id").alias("place"), "path", none.alias("filename"), F.lit("text/html").alias("mime_type"))
    again = pages.where("page_id % 3 = 0").select(F.lit("c"), "page_id", "path", F.lit("copy.html"), none)
    nowhere = pages.where("page_id % 5 = 0").select(F.lit("m"), "page_id", F.expr("concat('none/', page_id)"), none, none)
    return own.union(again).union(nowhere)


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Pages, and the store after their files were written and attached."""
    pages, folder = _pages(spark, sf_dir), _folder(spark, "attachments")
    s.write_bytes(pages, folder)
    files = spark.createDataFrame([], "file_id string, content_id string, filename string, mime_type string, byte_length long")
    return pages, f.attached(_wanted(pages), folder, files, spark.createDataFrame([], "content_id string, bytes binary"))


@query("attachment_load", f"""WITH {_FILES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY owner, file_id ORDER BY page_id) AS k FROM i)
    SELECT owner, page_id AS place, CASE WHEN k = 1 THEN file_id END AS file_id, CASE WHEN k = 1 THEN '' ELSE 'repeated' END AS problem FROM r
    UNION ALL SELECT 'm', page_id, NULL, 'missing' FROM p WHERE page_id % 5 = 0""")
def attachment_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files and attached: links, and what can't be."""
    got = _store(spark, sf_dir)[1]
    return got["links"].withColumn("problem", F.lit("")).unionByName(got["rejected"].drop("path").withColumn("file_id", F.lit(None).cast("string")))


@query("file_store", f"""WITH {_FILES_SQL} SELECT DISTINCT file_id, content_id, filename, mime_type, byte_length FROM i""")
def file_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of these attachments, each once."""
    return _store(spark, sf_dir)[1]["files"]


@query("file_bytes", f"""WITH {_FILES_SQL}, d AS (SELECT DISTINCT file_id, content_id, byte_length FROM i)
    SELECT file_id, CASE WHEN substr(file_id, 1, 1) = '0' THEN 'corrupt' ELSE '' END AS problem, CASE WHEN substr(file_id, 1, 1) <> '0' THEN content_id END AS digest, CASE WHEN substr(file_id, 1, 1) <> '0' THEN byte_length END AS bytes FROM d
    UNION ALL SELECT 'page ' || page_id, 'missing', NULL, NULL FROM p""")
def file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of all files, by digest and length: those whose id begins with 0 say a wrong length, and a
    name that no file has is asked for each page."""
    pages, got = _store(spark, sf_dir)
    wrong = F.col("file_id").startswith("0")
    files = got["files"].withColumn("byte_length", F.when(wrong, F.col("byte_length") + 1).otherwise(F.col("byte_length")))
    asked = got["files"].select("file_id").union(pages.select(F.concat(F.lit("page "), "page_id")))
    read = f.file_bytes(asked, files, got["contents"])
    return read.select("file_id", "problem", F.sha2("bytes", 256).alias("digest"), F.octet_length("bytes").cast("long").alias("bytes"))


@query("compact_copy", f"""WITH {_FILES_SQL}, b AS (SELECT DISTINCT content_id, byte_length, bool_and(page_id % 2 = 0 AND filename <> 'copy.html') OVER (PARTITION BY content_id) AS free FROM i)
    SELECT content_id, byte_length, NOT free AS kept FROM b""")
def compact_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy without the contents that are kept elsewhere: of even pages, if no copy holds them."""
    _, got = _store(spark, sf_dir)
    even = F.regexp_extract("filename", r"^(\d+)\.html$", 1)
    bound = got["files"].where((even != "") & (even.cast("long") % 2 == 0)).select("file_id")
    kept, dropped = f.repacked(got["files"], got["contents"], bound, got["contents"].where("false"))
    path = _folder(spark, "compact")
    save_store({"contents": kept, "left_out": dropped}, path)
    again = load_store(spark, path, ["contents", "left_out"])
    size = F.octet_length("bytes").cast("long").alias("byte_length")
    return again["contents"].select("content_id", size, F.lit(True).alias("kept")).union(again["left_out"].select("content_id", size, F.lit(False)))


@query("store_create", f"""WITH {TURNS_SQL} SELECT 'turns' AS "table", id AS key, content AS body FROM turns UNION ALL SELECT 'owner', 'conversations', NULL""")
def store_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store is made, turns are appended in two parts, and all its tables are read again."""
    path = _folder(spark, "store")
    s.create_store(spark, path, {"turns": "id string, role string, content string", "branches": "id string, leaf string"}, "conversations")
    t = turns(spark, sf_dir).select("id", "role", "content")
    for role in ("role = 'user'", "role is null or role <> 'user'"):
        save_store({"turns": t.where(role)}, path)
    got = load_store(spark, path, ["turns", "branches", "owner"])
    rows = got["turns"].select(F.lit("turns").alias("table"), F.col("id").alias("key"), F.col("content").alias("body"))
    none = F.lit(None).cast("string")
    return rows.union(got["branches"].select(F.lit("branches"), "id", "leaf")).union(got["owner"].select(F.lit("owner"), "owner", none))


_CATALOG_SQL = """c AS (SELECT DISTINCT conv_id AS c FROM conversations)
    SELECT CAST(c AS VARCHAR) AS conversation_id, CASE WHEN c % 4 = 3 THEN 'A "later", title ' || c ELSE 'Title ' || c END AS title, CAST(CASE WHEN c % 4 = 3 THEN 2 ELSE 1 END AS BIGINT) AS matched,
           CAST(CASE WHEN c % 4 = 3 THEN 1 ELSE 0 END + CASE WHEN c % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS updates FROM c WHERE c % 4 <> 1"""


@query("title_backfill", f"WITH {_CATALOG_SQL}")
def title_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from gzipped catalogs: with white space around, without a title (1 of 4), twice (3 of 4), of
    unknown conversations; odd conversations have theirs already."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c")).distinct()
    own, path = F.concat(F.lit("Title "), "c"), _folder(spark, "titles")
    row = lambda order, title, who=F.col("c").cast("string"): F.struct(F.lit(order).alias("o"), who.alias("conversation_id"), title.alias("title"))
    k = F.col("c") % 4
    rows = F.array(
        row(0, F.when(k == 1, "  ").otherwise(F.concat(F.lit(" "), own, F.lit("\t")))),
        row(1, F.when(k == 3, F.concat(F.lit('A "later", title '), "c")).otherwise("")),
        row(2, F.lit("Nobody's"), F.concat(F.lit("x"), "c")),
    )
    catalog = c.select("c", F.explode(rows).alias("r")).select("c", "r.*").repartition(4, "c").sortWithinPartitions("c", "o")
    catalog.select("conversation_id", "title").write.option("header", True).option("escape", '"').option("compression", "gzip").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    stored = c.select(F.col("c").cast("string").alias("conversation_id"), F.when(F.col("c") % 2 == 1, own).alias("title"))
    return f.backfilled(s.read_title_rows(spark, path), stored)
