"""Readers and writers: tagged JSON lines, title files, attachments, stores as folders of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = """kind string, id string, conversation_id string, parent_id string, role string, timestamp_ns long, content string,
    attachments array<struct<path:string,filename:string,mime_type:string>>, leaf_node_id string, canonical boolean, title string,
    message_id string, sequence long, model_round int, event_kind string, correlation_id string, name string"""
_COLUMNS = {
    "node": ["id", "conversation_id", "parent_id", "role", "timestamp_ns", "content", "attachments"],
    "branch": ["id", "conversation_id", "leaf_node_id", "canonical", "title"],
    "echo": ["conversation_id", "message_id", "sequence", "timestamp_ns", "model_round", "event_kind", "correlation_id", "name", "content"],
}


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, branches and echoes of JSON lines tagged by kind; lines of other kinds, and lines that
    aren't JSON, are in `rejected`."""
    rows = spark.read.schema(_RECORD + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    out = {kind: rows.where(F.col("kind") == kind).select(*columns) for kind, columns in _COLUMNS.items()}
    # asked of the text, as Spark reads no corrupt record by itself
    text = spark.read.text(path).where(F.trim("value") != "")
    out["rejected"] = text.where(~F.coalesce(F.get_json_object("value", "$.kind").isin(list(_COLUMNS)), F.lit(False)))
    return out


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, title) of a CSV, plain or gzipped; the last title of a conversation wins."""
    rows = spark.read.schema("conversation_id string, title string").option("header", True).option("multiLine", True).csv(path)
    return rows.groupBy("conversation_id").agg(F.max_by("title", F.monotonically_increasing_id()).alias("title"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, filename, byte_length, bytes): files by the digest of their bytes, each once."""
    f = spark.read.format("binaryFile").load(path)
    named = f.select(F.sha2("content", 256).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("byte_length"), F.col("content").alias("bytes"))
    return named.dropDuplicates(["file_id"])


def save_store(tables: dict[str, DataFrame], path: str) -> None:
    """Appends each table to its folder."""
    for name, df in tables.items():
        df.write.mode("append").parquet(f"{path}/{name}")


def load_store(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def repacked(tables: dict[str, DataFrame], keep: dict[str, str]) -> dict[str, DataFrame]:
    """Tables without the rows that a condition (SQL, by table) leaves out."""
    return {name: df.where(keep[name]) if name in keep else df for name, df in tables.items()}


def ingested(stored: DataFrame, incoming: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new, conflicts) of rows to be stored: equal rows are ingested once, others of a stored key conflict."""
    rows = incoming.distinct()
    rest = [c for c in incoming.columns if c not in key]
    digest = F.sha2(F.to_json(F.struct(*rest)), 256)
    known = stored.select(*key, digest.alias("_stored"))
    joined = rows.withColumn("_digest", digest).join(known, key, "left")
    several = rows.groupBy(*key).agg((F.count("*") > 1).alias("_several"))
    judged = joined.join(several, key)
    clash = (F.col("_stored").isNotNull() & (F.col("_stored") != F.col("_digest"))) | (F.col("_stored").isNull() & F.col("_several"))
    drop = ("_digest", "_stored", "_several")
    return judged.where(F.col("_stored").isNull() & ~F.col("_several")).drop(*drop), judged.where(clash).drop(*drop)
