"""Operator 7: lines that many documents share are dropped from all but one of them.

Lines are exploded to (document, position, 128-bit hash of the key); the distinct documents of each
hash are counted, with the largest; lines of hashes over the threshold lose their positions in all
other documents; the remaining stretches of each text are put together by position. Only hashes and
positions are shuffled, but for the join that brings a document its dropped positions. Counting
first makes (hash, document) distinct, so a line that a third of all documents hold is summed in
each task before it meets. The common lines are written before they are joined with all lines: where
Spark finds that table small it is broadcast, else adaptive execution can split a hot line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, texts_of, written

#: A key's fewest code points, and the fewest documents that make it common.
LEAST_CHARS, LEAST_DOCS = 40, 5
_WHITE = " \t\n\x0b\x0c\r"


def line_key(line: str, least: int) -> bytes | None:
    """The bytes of a line's key, A-Z in lower case; None if it is short."""
    line = line.strip(_WHITE)
    return line.encode().lower() if len(line) >= least else None  # bytes.lower changes A-Z only


def _lines(rows: DataFrame, least: int) -> DataFrame:
    """(id, h, pos, high, low): each line with a long key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, digests = [], [], []
            for i, text in enumerate(texts_of(batch, "text")):
                for k, line in enumerate(text.split("\n")):
                    if len(line) >= least and (key := line_key(line, least)) is not None:
                        at.append(i)
                        pos.append(k)
                        digests.append(xxhash.xxh3_128_digest(key))
            halves = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(taken), batch.column("h").take(taken), pa.array(pos, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["id", "h", "pos", "high", "low"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, h long, pos int, high long, low long")


def drop_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., kept_text, n_lines, n_dropped) for every row of docs.

    Null text is one empty line, as is empty text; kept_text is then empty. Documents are distinct
    ids: repeated rows count once, and each of them is treated alike; a null id is no document for
    the count and is never the largest. An empty table gives an empty result. A document that
    loses all lines has an empty kept_text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"keep_{c}") for c in keep), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    lines = _lines(rows.select("id", "h", "text"), least_chars)
    common = written(
        lines.select("high", "low", "id").distinct().groupBy("high", "low").agg(F.count("id").alias("docs"), F.max("id").alias("last"))
        .where(F.col("docs") >= least_docs).select("high", "low", "last"),
        "common-lines",
    )
    dropped = lines.join(common, ["high", "low"]).where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id", "h").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    d = dropped.select(F.col("id").alias("d_id"), F.col("h").alias("d_h"), "dropped")
    joined = rows.join(d.hint("shuffle_hash"), rows["id"].eqNullSafe(d["d_id"]) & (rows["h"] == d["d_h"]), "left")
    split = joined.withColumn("lines", F.split("text", "\n")).withColumn("n_lines", F.size("lines").cast("long"))
    # The stretches between dropped positions: each begins one after a dropped line.
    edges = F.concat(F.array(F.lit(-1)), F.col("dropped"), F.array(F.size("lines")))
    stretches = F.transform(
        F.sequence(F.lit(1), F.size("dropped") + 1),
        lambda k: F.slice(F.col("lines"), F.element_at(F.col("edges"), k) + 2, F.element_at(F.col("edges"), k + 1) - F.element_at(F.col("edges"), k) - 1),
    )
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    n_dropped = F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(F.size("dropped")).cast("long")
    return split.withColumn("edges", edges).select(
        F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep), kept.alias("kept_text"), "n_lines", n_dropped.alias("n_dropped")
    )


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256)."""
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
