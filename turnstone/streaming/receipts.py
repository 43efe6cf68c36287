"""Receipts of a stream applied to a table exactly once.

The table is kept in buckets of ids, each a folder of Parquet for every batch that changed it. A batch
writes new folders for the buckets that it touches and is then entered into a ledger, whose last
entry names the folder of every bucket. Readers follow the ledger, so that a batch is there as a
whole or not at all; one that is in the ledger already isn't applied again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sessions import upsert

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def entries(spark: SparkSession, path: str) -> list[int]:
    """Batches in the ledger of the table at path."""
    fs, p = _fs(spark, f"{path}/ledger")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def _entry(spark: SparkSession, path: str, batch: int) -> dict[str, int]:
    return json.loads(spark.read.text(f"{path}/ledger/{batch}", wholetext=True).first()[0])


def enter(spark: SparkSession, path: str, batch: int, folders: dict[str, int]) -> None:
    """Writes an entry beside the ledger and moves it in, which is one step for a reader."""
    fs, tmp = _fs(spark, f"{path}/ledger/_{batch}")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    if not fs.rename(tmp, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger/{batch}")):
        raise RuntimeError(f"batch {batch} is in the ledger already")


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as of the last entry."""
    done = entries(spark, path)
    folders = [f"{path}/rows/batch={b}/bucket={k}" for k, b in _entry(spark, path, done[-1]).items()] if done else []
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def apply_batch(path: str, receipts: DataFrame, batch: int, buckets: int = BUCKETS) -> None:
    """receipts (episode_id, attempt, result) into the table: the larger attempt of an id wins. For
    foreachBatch. A batch that is run twice, or again after the driver died before its entry was
    made, changes nothing."""
    spark = receipts.sparkSession
    done = entries(spark, path)
    if done and batch <= done[-1]:
        return
    new = receipts.select("episode_id", "attempt", "result")
    bucket = F.pmod(F.xxhash64("episode_id"), F.lit(buckets)).cast("int")
    touched = {str(r[0]) for r in new.select(bucket.alias("b")).distinct().collect()}  # buckets at most
    folders = _entry(spark, path, done[-1]) if done else {}
    if touched:
        schema = new.schema
        old = [f"{path}/rows/batch={folders[k]}/bucket={k}" for k in touched if k in folders]
        before = spark.read.schema(schema).parquet(*old) if old else new.limit(0)
        upsert(before, new).withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    enter(spark, path, batch, folders | dict.fromkeys(touched, batch))


def receipt_stream(receipts: DataFrame, path: str, buckets: int = BUCKETS):
    """A stream writer that applies a stream of receipts to the table at path; name its checkpoint and start it."""
    return receipts.writeStream.foreachBatch(lambda df, batch: apply_batch(path, df, batch, buckets))
