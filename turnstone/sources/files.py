"""Files by path, stores and catalogs of titles: what is read is read in tasks, each path once."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .graphlines import _system

#: Bytes of a file that fit a row, bytes of rows that go on together, paths of a task.
MOST_BYTES, BATCH_BYTES, PATHS = 1 << 30, 16 << 20, 256
_BYTES = pa.schema([("path", pa.string()), ("bytes", pa.binary()), ("problem", pa.string())])


def _placed(folder: str, path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Where a path is: as it stands if it is absolute, else in the folder."""
    if "://" in path or path.startswith("/"):
        return _system(path)
    fs, at = _system(folder)
    return fs, posixpath.join(at, path)


def read_bytes(paths: DataFrame, folder: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, bytes, problem) of every distinct path of paths (path), absolute or relative to folder.

    problem: '' or `missing`, `no file` (a folder), `too large` (more than `most` bytes); then there are
    no bytes. Other failures are failures of the task, which Spark tries again. Null paths are left out.
    """
    once = cut(paths.where("path is not null").select("path").distinct(), "paths")
    cores = paths.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(once.count(), max(cores, -(-once.count() // PATHS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = _placed(folder, path)
                info = fs.get_file_info(at)
                problem = "missing" if info.type == pyarrow.fs.FileType.NotFound else "no file" if not info.is_file else "too large" if info.size > most else ""
                data = None
                if not problem:
                    with fs.open_input_file(at) as f:
                        data = f.read()
                rows.append((path, data, problem))
                size += len(data or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist([dict(zip(_BYTES.names, r, strict=True)) for r in rows], _BYTES)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_BYTES.names, r, strict=True)) for r in rows], _BYTES)

    return once.repartition(parts).mapInArrow(run, "path string, bytes binary, problem string")


def write_bytes(rows: DataFrame, folder: str) -> DataFrame:
    """(path, byte_length) of rows (path, bytes) after each was written to its place in folder, as a table.

    A file is written under a name of its own and then moved, so that a task that runs twice leaves one
    whole file. Rows without path or bytes write nothing; a path that is absolute or leads out of the
    folder is an error, and so is one that is there twice in rows with different bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _system(folder)
        for b in batches:
            done = []
            for path, data in zip(b.column("path").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                if posixpath.isabs(path) or posixpath.normpath(path).startswith(".."):
                    raise ValueError(f"{path} leads out of the folder")
                at = posixpath.join(top, posixpath.normpath(path))
                fs.create_dir(posixpath.dirname(at), recursive=True)
                new = f"{posixpath.dirname(at)}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(new) as f:
                    f.write(data)
                fs.move(new, at)
                done.append((path, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "byte_length"])

    rows = cut(rows.where("path is not null and bytes is not null").select("path", F.col("bytes").cast("binary").alias("bytes")), "to-write")
    if twice := rows.groupBy("path").agg(F.count_distinct(F.sha2("bytes", 256)).alias("n")).where("n > 1").head():
        raise ValueError(f"{twice.path} is to hold different things")
    return cut(rows.mapInArrow(run, "path string, byte_length long"), "were-written")


def read_title_rows(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, title, file, place) of catalogs, CSV with a header, plain or gzipped: columns are
    found by name, files of a folder have the same ones, quotes are doubled inside quotes. place grows
    along a file."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select("conversation_id", "title", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))


def create_store(spark: SparkSession, path: str, schemas: dict[str, str], owner: str) -> None:
    """A new store in the folder path: an empty table for each schema, and whose it is. A folder that is
    there already is left as it is, and an error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileExistsError(path)
    if not owner or "owner" in schemas:
        raise ValueError("a store has one owner, and a table of that name")
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")
    spark.createDataFrame([(owner,)], "owner string").coalesce(1).write.parquet(f"{path}/owner")  # last: a store with an owner is whole
