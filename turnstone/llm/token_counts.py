"""Operator 1: token counts through a digest cache.

Texts are named by a digest of their normalised content (null becomes empty; a byte-level
vocabulary counts every other difference). A cache table holds (tokenizer digest, content digest,
count). Digests without a stored count are encoded once each, by one row that has them, and are
appended; every row then takes its count from the cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, small_batches, text_or_empty, texts_of, written
from .pieces import PieceEncoder

CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


@cache
def library_encoder(file: bytes) -> PieceEncoder:
    """A tokenizers-library vocabulary, one for each Python worker. file: its JSON."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_buffer(file)
    t.no_truncation()
    t.no_padding()
    return PieceEncoder(lambda pieces: [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)], [x.content for x in t.get_added_tokens_decoder().values()])


def tokenizer_file(path: str) -> tuple[bytes, str]:
    """The file of a byte-level tokenizers-library vocabulary, and its digest."""
    with open(path, "rb") as f:
        file = f.read()
    return file, hashlib.sha256(file).hexdigest()


def stored_counts(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) in the cache, empty if there is none. Counts stored twice are one."""
    try:
        cached = spark.read.schema(CACHE).parquet(cache_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cached = spark.createDataFrame([], CACHE)
    return cached.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs.

    cache_path: a Parquet folder that is read and appended to; None: a new one in the shared
    folder. Null text counts as empty (0 bytes, 0 tokens). Rows with a null id and repeated rows
    are kept as they are. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    file, tokenizer = tokenizer_file(tokenizer_path)
    cache_path = cache_path or fresh_path(spark, "token-counts")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = written(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    # One row for each digest that the cache lacks: identity by (id, digest), null ids included.
    misses = keyed.groupBy("digest").agg(F.min("id").alias("id")).join(stored_counts(spark, cache_path, tokenizer), "digest", "left_anti")
    m = misses.select(F.col("id").alias("m_id"), F.col("digest").alias("m_digest"))
    chosen = rows.join(m.hint("shuffle_hash"), rows["digest"].eqNullSafe(m["m_digest"]) & rows["id"].eqNullSafe(m["m_id"])).select("text", "digest")
    shared = spark.sparkContext.broadcast(file)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(shared.value)
        for batch in batches:
            counts = encoder.counts(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([pa.array([tokenizer] * len(counts), pa.string()), batch.column("digest"), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    chosen.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    # Written, so that the join is a broadcast if Spark finds the counts small, and else one in which
    # adaptive execution can split a digest that very many rows share.
    counts = written(stored_counts(spark, cache_path, tokenizer).join(keyed.select("digest").distinct(), "digest", "left_semi"), "counts")
    n = F.col("n_tokens")
    return keyed.join(counts, "digest", "left").select(F.col("id").alias(id_col), "n_bytes", n, (n > limit).alias("over_limit"))
