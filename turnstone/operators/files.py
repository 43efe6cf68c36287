"""Files by content: attachments of turns, bytes of files, copies without what is kept elsewhere, titles.

A file (file_id, content_id, filename, mime_type, byte_length) names a content (content_id, bytes); equal
bytes are one content, however many files have them. Bytes are shuffled by content only, never by owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_trimmed
from ..session import cut
from ..sources.files import MOST_BYTES, read_bytes
from .records import identifier

FILE = ("file_id", "content_id", "filename", "mime_type", "byte_length")
#: Rows of a catalog in which changes are looked for at once.
STRETCH = 65536


def file_id(content_id: Column, byte_length: Column, filename: Column, mime_type: Column) -> Column:
    """The name of a file; no type and an empty one are the same."""
    return identifier("file", content_id, byte_length, filename, F.coalesce(mime_type, F.lit("")))


def attached(wanted: DataFrame, folder: str, files: DataFrame, contents: DataFrame, most: int = MOST_BYTES) -> dict[str, DataFrame]:
    """Attachments wanted (owner, place, path, filename, mime_type) read from folder and taken into files
    and contents.

    links: (owner, place, file_id); files, contents: what the stored ones lack; rejected: (owner, place,
    path, problem). filename: null for the path's last part. Problems: those of `read_bytes`; `no
    filename`; `empty type`; `repeated`, if an earlier place of the owner has the same file; `conflict`, if
    the file is stored as something else.
    """
    wanted = wanted.select("owner", "place", "path", "mime_type", F.coalesce("filename", F.element_at(F.split("path", "/"), -1)).alias("filename"))
    read = cut(read_bytes(wanted, folder, most).withColumns({"content_id": F.sha2("bytes", 256), "byte_length": F.octet_length("bytes").cast("long")}), "read")
    facts = read.select("path", "content_id", "byte_length", "problem")
    unnamed = F.coalesce(F.col("filename").isin("", ".", ".."), F.lit(True))
    problem = F.when(unnamed, "no filename").when(F.col("mime_type") == "", "empty type").otherwise(F.coalesce("problem", F.lit("missing")))
    rows = wanted.join(facts, "path", "left").withColumn("problem", problem)
    rows = rows.withColumn("file_id", F.when(F.col("problem") == "", file_id(F.col("content_id"), F.col("byte_length"), F.col("filename"), F.col("mime_type"))))
    first = F.row_number().over(Window.partitionBy("owner", "file_id", F.when(F.col("file_id").isNull(), F.col("path"))).orderBy("place"))
    held = files.select("file_id", F.struct("content_id", "filename", F.coalesce("mime_type", F.lit("")), "byte_length").alias("_held"))
    own = F.struct("content_id", "filename", F.coalesce("mime_type", F.lit("")), "byte_length")
    rows = rows.withColumn("_n", first).join(held, "file_id", "left")
    problem = F.when(F.col("problem") != "", F.col("problem")).when(F.col("_n") > 1, "repeated").when(F.col("_held").isNotNull() & (F.to_json("_held") != F.to_json(own)), "conflict").otherwise("")
    rows = cut(rows.withColumn("problem", problem).withColumn("_known", F.col("_held").isNotNull()).drop("_held", "_n"), "attachments")
    good = rows.where("problem = ''")
    new = good.where("not _known").select(*FILE).dropDuplicates(["file_id"])
    # of paths with equal bytes, the least one's go on
    chosen = good.groupBy("content_id").agg(F.min("path").alias("path")).join(contents.select("content_id"), "content_id", "left_anti")
    return {
        "links": good.select("owner", "place", "file_id"),
        "files": new,
        "contents": read.join(chosen.select("path"), "path", "left_semi").select("content_id", "bytes"),
        "rejected": rows.where("problem <> ''").select("owner", "place", "path", "problem"),
    }


def file_bytes(asked: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, bytes, problem) of every row of asked (file_id): '' or `missing` (no such file), `no
    content`, `corrupt` (bytes of another length or digest than the file says); then there are no bytes."""
    found = asked.select("file_id").join(files.select("file_id", "content_id", "byte_length", F.lit(True).alias("_file")), "file_id", "left")
    found = found.join(contents.select("content_id", "bytes"), "content_id", "left")
    whole = (F.octet_length("bytes") == F.col("byte_length")) & (F.sha2("bytes", 256) == F.col("content_id"))
    problem = F.when(F.col("_file").isNull(), "missing").when(F.col("bytes").isNull(), "no content").when(~whole, "corrupt").otherwise("")
    return found.withColumn("problem", problem).select("file_id", F.when(F.col("problem") == "", F.col("bytes")).alias("bytes"), "problem")


def repacked(files: DataFrame, contents: DataFrame, bound: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) contents of a compact copy: dropped are those of which every file is kept elsewhere
    (bound: file_id) and that nothing else (others: content_id) has. A content without a file is kept. If
    there is nothing to drop, the copy is an error."""
    elsewhere = bound.select("file_id").distinct().withColumn("_bound", F.lit(True))
    of = files.select("file_id", "content_id").join(elsewhere, "file_id", "left").groupBy("content_id").agg(F.every(F.coalesce("_bound", F.lit(False))).alias("all"))
    free = cut(of.where("all").select("content_id").join(others.select("content_id"), "content_id", "left_anti").join(contents.select("content_id"), "content_id", "left_semi"), "removable")
    if free.isEmpty():
        raise ValueError("nothing can be left out")
    return contents.join(free, "content_id", "left_anti"), contents.join(free, "content_id", "left_semi")


def backfilled(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, title, matched, updates) of conversations (conversation_id, title) that a catalog
    (conversation_id, title, file, place) names.

    Rows come by file and place; white space around titles goes, and rows without a title are skipped,
    as are unknown conversations. updates: rows that change the title as it is then, the stored one at
    first. title: the last one. Changes are found in stretches of a file; stretches meet a row each.
    """
    t = blank_trimmed(F.col("title"))
    known = conversations.select("conversation_id", F.col("title").alias("_stored"))
    named = rows.select("conversation_id", t.alias("title"), "file", "place", F.expr(f"place div {STRETCH}").alias("stretch")).where("title <> ''").join(known, "conversation_id")
    part = ["conversation_id", "file", "stretch"]
    changed = F.col("title") != F.lag("title").over(Window.partitionBy(*part).orderBy("place"))
    inner = named.withColumn("_changed", F.coalesce(changed, F.lit(False))).groupBy(*part).agg(
        F.count("*").alias("n"), F.count_if("_changed").alias("changes"), F.min_by("title", "place").alias("first"), F.max_by("title", "place").alias("last"), F.first("_stored").alias("_stored")
    )
    before = F.coalesce(F.lag("last").over(Window.partitionBy("conversation_id").orderBy("file", "stretch")), F.col("_stored"))
    heads = inner.withColumn("changes", F.col("changes") + (~before.eqNullSafe(F.col("first"))).cast("long"))
    return heads.groupBy("conversation_id").agg(F.max_by("last", F.struct("file", "stretch")).alias("title"), F.sum("n").alias("matched"), F.sum("changes").alias("updates"))
