"""Helpers shared by the training-data operators: shared folders, batch limits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python. Documents can be long, so batches are small.
ARROW_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Where that is unset a local session, as in tests,
    gets a folder under /tmp; on a cluster it is an error, since each machine would write its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file:///tmp/turnstone-checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/turnstone/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the application's part of the shared folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors cost nothing.

    instead_of: a table written before that nothing will read once this one is there; it is
    taken away. Other tables stay until `clear_scratch`, as results are read lazily.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if instead_of is not None:
        forget(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(df: DataFrame) -> None:
    """Takes away the files of a table made by `written`."""
    if path := df.__dict__.get("_written"):
        removed(df.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    """Takes a table away that nothing will read again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Takes away all tables that this application's operators wrote, once their results are read."""
    removed(spark, scratch(spark))


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once. The setting stays, as plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column, null as empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def grouped_by_size(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to limit, or single larger ones."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_prefix(df: DataFrame, prefix: str = "_") -> str:
    """prefix with as many underscores as it takes that no column of df begins with it."""
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix
