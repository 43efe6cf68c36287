"""Operator 2: exact top-k by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights by term (component). Queries are taken in blocks of a
bounded number, which are broadcast. Each task turns a block of candidates into postings by term
and, term after term, scatters query weight times posting weight into dense score arrays of a tile
of queries. It selects each query's best k of the block and merges them with those it has; the best
of all tasks are merged by rank. No pair of query and candidate leaves a task but the best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, small_batches

#: Queries that are broadcast at once; candidates of a block of postings; queries of a tile of scores.
QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 4096, 4096, 64
SCALE = 256


def usable(vector: str | Column) -> Column:
    """Whether a vector has finite components only."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def weights(vector: str, scale: int = SCALE) -> Column:
    """Components as integers: floor(scale * x)."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


class Postings:
    """A block of rows by term: the rows that have the term, and their weights."""

    def __init__(self, rows: list[list[int]]):
        self.size = len(rows)
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.terms = int(lengths.max(initial=0))
        dense = np.zeros((self.terms, self.size), dtype=np.int64)
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            dense[:n, at] = np.array([rows[i] for i in at], dtype=np.int64).reshape(len(at), n).T
        self.largest = int(np.abs(dense).max(initial=0))
        self.lists = []
        for t in range(self.terms):
            at = np.flatnonzero(dense[t])
            full = 2 * len(at) > self.size  # a list that most rows are in is kept as an array of them all
            self.lists.append((None, dense[t].copy()) if full else (at, dense[t, at]))

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of a tile of queries with all rows, term after term."""
        bound = int(np.abs(queries).max(initial=0)) * self.largest * max(1, min(self.terms, queries.shape[1]))
        if bound >= 1 << 63:
            raise OverflowError("a score doesn't fit in 64 bits")
        kind = np.int32 if bound < 1 << 31 else np.int64
        out = np.zeros((len(queries), self.size), dtype=kind)
        for t in range(min(self.terms, queries.shape[1])):
            at, w = self.lists[t]
            having = np.flatnonzero(queries[:, t])
            if not len(having) or not len(w):
                continue
            add = queries[having, t].astype(kind)[:, None] * w.astype(kind)[None, :]
            if at is None:
                out[having] += add
            else:
                out[np.ix_(having, at)] += add
        return out


def best(scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its k best (scores, ids), smaller ids first among equals, its own id left out."""
    out = []
    # one more than k may be needed for each row of the query's own id
    for row, q in zip(scores, query_ids, strict=True):
        others = ids != q
        row, named = (row, ids) if others.all() else (row[others], ids[others])
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero(row >= least)
            row, named = row[at], named[at]
        order = np.lexsort((named, -row.astype(np.int64)))[:k]
        out.append((row[order].astype(np.int64), named[order]))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): each query's k rows of the largest integer inner product.

    Every row of vectors but those with the query's own id is a candidate; all of them, if fewer
    than k. Ties go to the smaller id. Rows with a null id, and vectors that are null or hold null,
    NaN or infinite components take no part, on either side. Vectors of different lengths agree on
    the terms that both have. A query id is answered once, however often its row is there; if its
    rows hold different vectors, the one with the least weights is asked. Repeated rows are
    candidates each, so an id that is there twice can take two ranks. An empty table gives an empty
    result. A score beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    clean = lambda df: df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), weights(vector_col).alias("w"))
    asked, rows = clean(queries).groupBy("id").agg(F.min("w").alias("w")), clean(vectors)
    blocks = -(-asked.count() // query_block)
    folder = fresh_path(spark, "top-k")
    form = "query_id long, vec long, score long"
    spark.createDataFrame([], form).write.parquet(folder)

    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()  # about query_block rows
        if not mine:
            continue
        width = max(len(r["w"]) for r in mine)
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in mine]), np.array([r["w"] + [0] * (width - len(r["w"])) for r in mine], dtype=np.int64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, q = shared.value
            kept: list[tuple[np.ndarray, np.ndarray]] | None = None

            def block(ids: list[int], rows: list[list[int]]) -> None:
                nonlocal kept
                postings, names, new = Postings(rows), np.array(ids), []
                for a in range(0, len(q), TILE):
                    new += best(postings.scores(q[a : a + TILE]), names, query_ids[a : a + TILE], k)
                if kept:
                    for i, (s, v) in enumerate(new):
                        s, v = np.concatenate((kept[i][0], s)), np.concatenate((kept[i][1], v))
                        order = np.lexsort((v, -s))[:k]
                        new[i] = s[order], v[order]
                kept = new

            ids, held = [], []
            for batch in batches:
                ids += batch.column("id").to_pylist()
                held += batch.column("w").to_pylist()
                if len(ids) >= CANDIDATE_BLOCK:
                    block(ids, held)
                    ids, held = [], []
            if ids:
                block(ids, held)
            for a in range(0, len(q) if kept else 0, 1024):
                part = kept[a : a + 1024]
                n = [len(s) for s, _ in part]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids[a : a + 1024], n), pa.int64()), pa.array(np.concatenate([v for _, v in part]), pa.int64()), pa.array(np.concatenate([s for s, _ in part]), pa.int64())], ["query_id", "vec", "score"])

        rows.mapInArrow(run, form).write.mode("append").parquet(folder)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")
    ranked = spark.read.schema(form).parquet(folder).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec").alias(id_col), "score")


def top_report(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """The 5 best of every row whose id is divisible by 50."""
    return top_k(embeddings, embeddings.where(F.col("vec_id") % every == 0))
