"""The corpus pipeline: five operators in a row over documents.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the
columns of documents; the last returns what it makes of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.common import free_prefix, fresh_path, n_partitions
from turnstone.llm.hyper_language import UNKNOWN, held_out, learn, predict
from turnstone.llm.line_dedup import drop_common_lines
from turnstone.llm.ngram_join import ngram_join
from turnstone.llm.pfair_mix import in_mixed_order, mix_sources
from turnstone.llm.tree_bpe import encode_decode


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): other columns in one, so that no name clashes with an operator's."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))).alias("rest"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.{c}") for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document the language that is found in its text, whatever it was labelled with, and
    rejects those in which none is found: texts that are null or have no letters. A low cosine is no
    ground to reject: a few clean words have one too."""
    found = predict(_packed(docs), learn(docs.where(~held_out())), keep=("text", "rest"))
    kept = found.where(F.col("lang_pred") != UNKNOWN)
    return kept.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col(c) if c in ("doc_id", "text") else F.col(f"rest.{c}") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes common lines out of all documents but one; n_chars is that of the new text."""
    kept = _unpacked(drop_common_lines(_packed(docs), keep=("rest",)).withColumnRenamed("kept_text", "text"), docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, once."""
    groups = ngram_join(docs)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first")).distinct()
    kept = docs.join(first.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(first["first"]), "left_semi")
    # a row that is there twice stays once
    own = free_prefix(docs) + "hash"
    return kept.withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own]).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts documents in the order of the mix, in which the written files then are."""
    own = free_prefix(docs)
    return in_mixed_order(mix_sources(docs, prefix=own), docs.count(), n_partitions(spark), own).select(docs.columns)


def _positions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, mix_position) of docs read from files that follow the mix: mix_position (from
    0) counts the rows of the files before by part number, and those before in its own. Readers open
    files in any order."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    own = free_prefix(docs)
    rows = docs.select("doc_id", "text", "lang", part.alias(own + "part"), F.col("_metadata.row_index").alias(own + "row"))
    before, begins = 0, []
    for number, n in sorted(tuple(r) for r in rows.groupBy(own + "part").count().collect()):  # one for each file
        begins.append((number, before))
        before += n
    begins = docs.sparkSession.createDataFrame(begins, f"{own}part long, {own}begin long")
    return rows.join(F.broadcast(begins), own + "part").select("doc_id", "text", "lang", (F.col(own + "begin") + F.col(own + "row")).alias("mix_position"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, digests of them and of the bytes that they decode to, its language
    and its place in the mix (mix_position)."""
    return encode_decode(_positions(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True, keep=("lang", "mix_position"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: SQL has neither the profiles of the first stage nor byte-pair merges: the tests hold the pipeline
#: against a brute-force version instead.
ORACLE_SQL = None
