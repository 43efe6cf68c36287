"""Operator 3: token ids in Arrow files of equal-length sequences.

Each shard is an Arrow IPC file whose record batches hold fixed-size lists: `tokens` (16 bits an
id where the vocabulary allows, else 32), `mask` (bits: false in the padding that ends a shard) and
`ends` (bits: true at the last id of a document). Mapped into memory, sequence i is a view of the
file, no byte of it copied. A second Arrow file beside it lists the shard's documents in order.
A shard's documents follow those of the shard before it, so all shards make one stream of ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, n_partitions, small_batches, text_or_empty, texts_of, written
from .token_counts import library_encoder, tokenizer_file

#: Ids of a sequence, and sequences of a record batch.
LENGTH, BATCH_ROWS = 2048, 128
INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def schema(wide: bool, length: int) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])


def _at(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if ":" in uri else (pyarrow.fs.LocalFileSystem(), uri)


class ShardWriter:
    """Writes documents' ids to {path}.arrow and their index to {path}.docs.arrow."""

    def __init__(self, path: str, wide: bool, length: int):
        fs, place = _at(path)
        fs.create_dir(place.rpartition("/")[0])
        self.schema, self.length, self.dtype = schema(wide, length), length, np.uint32 if wide else np.uint16
        self.sinks = [fs.open_output_stream(f"{place}{x}") for x in (".arrow", ".docs.arrow")]
        self.tokens, self.docs = (pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, INDEX), strict=True))
        self.ids, self.ends, self.waiting = [], [], 0

    def add(self, doc_ids: list[int | None], ids: list[np.ndarray]) -> None:
        counts = np.array([len(x) for x in ids], dtype=np.int64)
        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(counts)], schema=INDEX))
        ends = np.zeros(int(counts.sum()), dtype=bool)
        ends[np.cumsum(counts) - 1] = True
        self.ids += ids
        self.ends.append(ends)
        self.waiting += len(ends)
        if self.waiting >= self.length * BATCH_ROWS:
            self._flush(self.waiting // self.length * self.length)

    def _flush(self, n: int, padding: int = 0) -> None:
        ids, ends = np.concatenate([*self.ids, np.zeros(padding)]).astype(self.dtype), np.concatenate([*self.ends, np.zeros(padding, dtype=bool)])
        mask = np.arange(len(ids)) < len(ids) - padding
        for a in range(0, n, self.length * BATCH_ROWS):
            b = min(n, a + self.length * BATCH_ROWS)
            self.tokens.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x[a:b]), self.length) for x in (ids, mask, ends)], schema=self.schema))
        self.ids, self.ends, self.waiting = [ids[n:]], [ends[n:]], len(ids) - n

    def close(self) -> None:
        if self.waiting:
            padding = -self.waiting % self.length
            self._flush(self.waiting + padding, padding)
        for x in (self.tokens, self.docs, *self.sinks):
            x.close()


class TokenFile:
    """Random access to the sequences of one shard; on a local disk they are views of the file."""

    def __init__(self, path: str):
        fs, place = _at(path)
        source = pa.memory_map(f"{place}.arrow") if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(f"{place}.arrow")
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("tokens").type.list_size

    def __len__(self) -> int:
        return sum(self.reader.get_batch(i).num_rows for i in range(self.reader.num_record_batches))

    def sequence(self, batch: int, row: int) -> tuple[np.ndarray, pa.Array]:
        """The ids, as a view, and the mask of a row of a record batch."""
        b = self.reader.get_batch(batch)
        return b.column("tokens").slice(row, 1).flatten().to_numpy(zero_copy_only=True), b.column("mask").slice(row, 1).flatten()

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and ends of a batch, padding left out."""
        for i in range(self.reader.num_record_batches):
            b = self.reader.get_batch(i)
            ids, mask, ends = (b.column(k).flatten().to_numpy(zero_copy_only=k == "tokens") for k in ("tokens", "mask", "ends"))
            n = int(mask.sum())
            yield ids[:n], ends[:n]


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, length: int = LENGTH, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every text, each followed by end_id, in ascending id order.

    Returns the manifest (shard, path, n_docs, n_tokens). Null text is empty (its end_id alone is
    written). Null ids come first; rows with equal ids are ordered by text. An empty table gives no
    documents. Other columns are ignored. A task that is run again writes new files, and the
    manifest names only those of the run that counted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    file, _ = tokenizer_file(tokenizer_path)
    shared = spark.sparkContext.broadcast(file)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards or n_partitions(spark), "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(shared.value)
        shard, writer, n_docs, n_tokens = TaskContext.get().partitionId(), None, 0, 0
        wide = False
        for batch in batches:
            if not writer:
                from tokenizers import Tokenizer

                wide = max(Tokenizer.from_buffer(shared.value).get_vocab_size(), end_id + 1) > 1 << 16
                path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
                writer = ShardWriter(path, wide, length)
            end = np.array([end_id], dtype=writer.dtype)
            ids = [np.concatenate((x, end)) for x in encoder.ids(texts_of(batch, "text"), writer.dtype)]
            writer.add(batch.column("id").to_pylist(), ids)
            n_docs, n_tokens = n_docs + len(ids), n_tokens + sum(map(len, ids))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return written(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest.

    start: ids of all documents before it. ids_crc32: unsigned, of its ids as little-endian
    unsigned 32-bit integers.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # a row for each shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, place = _at(path)
                index = pa.ipc.open_file(fs.open_input_file(f"{place}.docs.arrow")).read_all()
                counts, sums, crc, size = [], [], 0, 0
                for ids, ends in TokenFile(path).stream():
                    wide, a = ids.astype("<u4"), 0
                    for b in (np.flatnonzero(ends) + 1).tolist():
                        counts.append(size + b - a)
                        sums.append(zlib.crc32(wide[a:b], crc))
                        a, crc, size = b, 0, 0
                    crc, size = zlib.crc32(wide[a:], crc), size + len(wide) - a
                if counts != index.column("n_tokens").to_pylist():
                    raise ValueError(f"{path}: the ends in its sequences and its index differ")
                n = np.array(counts, dtype=np.int64)
                yield from pa.table({"doc_id": index.column("doc_id"), "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": pa.array(sums, pa.int64())}).to_batches(65536)

    return placed.repartition(n_partitions(spark)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Writes the documents' ids to folder (None: a new shared one) and describes what was read back."""
    return read_documents(write_tokens(docs, folder or fresh_path(docs.sparkSession, "tokens"), tokenizer_path))
