"""Retrieval around the searches: branches and sessions, the statements' index, routed retrieval with its
guards and its fallback, packed vectors, generations of derived vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_score, lexical_terms, substring_count
from ..functions.vector import cosine
from ..session import cut
from .archive import range_text, windows
from .communities import admitted, routed
from .timeline import latest
from .vectors import hybrid, semantic_search

#: Texts of one request to a model, and requests at once.
REQUEST, REQUESTS = 16, 16


def branch_windows(rows: DataFrame, size: int = 8, overlap: int = 2) -> DataFrame:
    """(leaf, start, end, text): the closed windows of each branch. rows: (leaf, position, role, content)."""
    lengths = rows.groupBy("leaf").agg((F.max("position") + 1).cast("long").alias("length"))
    return range_text(rows, windows(lengths, ["leaf"], size, overlap), ["leaf"])


def branch_search(fragments: DataFrame, queries: DataFrame, k: int, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, leaf, start, end, score, rank): the windows (leaf, start, end, text) of each query's own
    branch that match best; later windows first among equals. queries: (query_id, leaf, terms[, query]).

    vectors: (leaf, start, vector) of the current generation, if there is one: scores are then fused
    with the cosine of the query's vector, and windows that only the vector finds are hits too.
    """
    terms = F.array_distinct("terms")
    asked = queries.select("query_id", "leaf", terms.alias("terms"), F.size(terms).alias("n"))
    met = fragments.join(asked, "leaf").select("query_id", "leaf", "start", "end", "n", F.lower("text").alias("low"), F.explode(F.array_intersect(lexical_terms(F.col("text")), "terms")).alias("term"))
    counted = met.withColumn("seen", F.least(substring_count(F.col("low"), F.col("term")), F.lit(4)))
    parts = counted.groupBy("query_id", "leaf", "start", "end", "n").agg(F.count("*").alias("m"), F.sum("seen").alias("s"))
    hits = parts.select("query_id", "leaf", "start", "end", lexical_score(F.col("m"), F.col("s"), F.col("n")).alias("score"))
    if vectors is not None:
        near = fragments.select("leaf", "start", "end").join(vectors, ["leaf", "start"]).join(queries.select("query_id", "leaf", "query"), "leaf")
        near = near.select("query_id", "leaf", "start", "end", cosine(F.col("vector"), F.col("query")).alias("score")).where("score > 0")
        hits = hybrid(hits, near, ["leaf", "start", "end"], 1 << 30).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("start"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def session_queries(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """Queries (query_id, session, ...) put to the leaf of their session (session, leaf, open); closed
    sessions answer nothing."""
    return asked.join(sessions.where("open").select("session", "leaf"), "session").drop("session")


def index_slots(slots: DataFrame, watermark: int, log: DataFrame, version: int) -> DataFrame:
    """(id, active) of the statements' index brought from a watermark to a version of the log (id,
    version, archived): what changed since is switched on or off, what is new and not archived is
    indexed. An index that is ahead of the log is built anew."""
    stale = watermark > version
    base = slots.limit(0) if stale else slots
    since = log.where((F.col("version") > (0 if stale else watermark)) & (F.col("version") <= version))
    changed = latest(since, ["id"], "version").select("id", (~F.col("archived")).alias("_on"))
    both = base.join(changed, "id", "full_outer")
    return both.where(F.col("active").isNotNull() | F.col("_on")).select("id", F.coalesce("_on", "active").alias("active"))


def retrieval_index(memories: DataFrame, vectors: DataFrame, members: DataFrame, snapshot_version: int, graph_version: int) -> DataFrame:
    """(id, vector, community) of current statements (id, archived) that have a vector. Communities
    (id, community) count only if the snapshot is of the graph's version."""
    known = memories.where("not archived").select("id").join(vectors.select("id", "vector"), "id")
    if snapshot_version != graph_version:
        return known.withColumn("community", F.lit(None).cast("int"))
    return known.join(members.select("id", "community"), "id", "left")


def stale(index: DataFrame, current: DataFrame, marks: list[str]) -> DataFrame:
    """(owner, stale, differs): whether any watermark of an owner's index isn't the current one."""
    both = index.select("owner", *(F.col(m).alias(f"_{m}") for m in marks)).join(current, "owner", "left")
    off = F.array_compact(F.array(*(F.when(~F.col(m).eqNullSafe(F.col(f"_{m}")), F.lit(m)) for m in marks)))
    return both.select("owner", (F.size(off) > 0).alias("stale"), F.array_join(off, ",").alias("differs"))


def retrieved(index: DataFrame, centroids: DataFrame, queries: DataFrame, seeds: int = 4, communities: int = 4, mode: str = "routed") -> DataFrame:
    """(query_id, id, score, rank, mode, fallback): each query's nearest statements (id, vector, community)
    of the communities it is routed to by centroids (community, centroid), and of those without one.

    `exact`, and routing without centroids or communities, searches all; fallback tells of the latter.
    Negative scores are kept. queries: (query_id, query), a stated batch.
    """
    chosen = cut(routed(centroids, queries, communities), "routes") if mode == "routed" else None
    if chosen is None or chosen.isEmpty():
        hits = semantic_search(index, queries, seeds, positive=False)
        return hits.select("query_id", "id", "score", "rank", F.lit("exact").alias("mode"), F.lit(mode == "routed").alias("fallback"))
    open_to = admitted(index.select("id", "community"), chosen)
    scores = open_to.join(index.select("id", "vector"), "id").join(queries, "query_id").select("query_id", "id", cosine(F.col("vector"), F.col("query")).alias("score")).where("score is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= seeds).select("query_id", "id", "score", "rank", F.lit("routed").alias("mode"), F.lit(False).alias("fallback"))


def of_owners(results: dict[str, DataFrame]) -> DataFrame:
    """The results of several owners side by side, with owner: they are not merged."""
    parts = [df.select(F.lit(name).alias("owner"), *df.columns) for name, df in results.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- packed vectors -----------------------------------------------------------------------------


def packed(vectors: DataFrame, group: str, id_col: str = "id", rows: int = 256) -> DataFrame:
    """(group, object, row_ids, dimensions, matrix): vectors of 32-bit floats, little-endian, in blocks of
    about `rows` by a hash of their id; object is the digest of the matrix, so equal ones are one."""
    sizes = vectors.groupBy(group).agg(F.ceil(F.count("*") / rows).alias("_blocks"))
    placed = vectors.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64(id_col), F.col("_blocks")))
    listed = placed.groupBy(group, "_block").agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col("vector")))).alias("_rows"))
    kind = dict(vectors.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, block in zip(b.column(group).to_pylist(), b.column("_rows").to_pylist(), strict=True):
                x = np.array([r["vector"] for r in block], dtype="<f4")
                yield pa.RecordBatch.from_pydict({"g": pa.array([g], b.column(group).type), "row_ids": pa.array([[r["id"] for r in block]]), "dimensions": pa.array([x.shape[1]], pa.int32()), "matrix": pa.array([x.tobytes()], pa.binary())})

    out = listed.select(group, "_rows").mapInArrow(pack, f"g {kind[group]}, row_ids array<{kind[id_col]}>, dimensions int, matrix binary")
    return out.select(F.col("g").alias(group), F.sha2("matrix", 256).alias("object"), "row_ids", "dimensions", "matrix")


def packed_cosines(objects: DataFrame, query: list[float], id_type: str = "long") -> DataFrame:
    """(id, score): the cosine, in double precision, of each row of packed vectors with a query."""
    q = np.array(query, dtype=np.float64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, n, raw in zip(b.column("row_ids"), b.column("dimensions").to_pylist(), b.column("matrix"), strict=True):
                x = np.frombuffer(raw.as_buffer(), dtype="<f4").reshape(-1, n).astype(np.float64)
                size = np.sqrt((x * x).sum(axis=1) * (q * q).sum())
                ok = np.isfinite(size) & (size > 0)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array((x @ q) / np.where(ok, size, 1), mask=~ok)], ["id", "score"])

    return objects.select("row_ids", "dimensions", "matrix").mapInArrow(score, f"id {id_type}, score double").where("score is not null")


def set_errors(sets: DataFrame, items: DataFrame) -> DataFrame:
    """(set, rows, repeated, unknown, missing): what is wrong with vector sets (set, id), one row for each
    item (id): items that a set lists twice, that don't exist, and that it lacks."""
    named = sets.groupBy("set", "id").agg(F.count("*").alias("n")).join(items.select("id", F.lit(True).alias("real")), "id", "left")
    per = named.groupBy("set").agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("real").isNull()).alias("unknown"), F.count("real").alias("_found"))
    total = items.agg(F.count("*").alias("_all"))  # one row
    return per.crossJoin(total).select("set", "rows", "repeated", "unknown", (F.col("_all") - F.col("_found")).alias("missing"))


def binding_errors(bindings: DataFrame) -> DataFrame:
    """(profile, body, sets): bodies that a profile binds to more than one set."""
    return bindings.groupBy("profile", "body").agg(F.count_distinct("set").alias("sets")).where("sets > 1")


def coverage(generations: DataFrame, fragments: DataFrame, rows: DataFrame, archive_version: int) -> DataFrame:
    """generations (generation, source_version, dimensions) with problem: `out of range` of the archive,
    `too old` for some fragment (fragment, created), `missing` vectors (generation, fragment, size),
    `dimensions`, or ''."""
    newest = fragments.agg(F.max("created").alias("_newest"), F.count("*").alias("_all"))  # one row
    counted = rows.groupBy("generation").agg(F.count_distinct("fragment").alias("_rows"), F.min("size").alias("_least"), F.max("size").alias("_most"))
    g = generations.join(counted, "generation", "left").crossJoin(newest)
    problem = (
        F.when((F.col("source_version") < 0) | (F.col("source_version") > archive_version), "out of range")
        .when(F.col("source_version") < F.col("_newest"), "too old")
        .when(F.coalesce("_rows", F.lit(0)) < F.col("_all"), "missing")
        .when((F.col("_least") != F.col("dimensions")) | (F.col("_most") != F.col("dimensions")), "dimensions")
        .otherwise("")
    )
    return g.select(*generations.columns, problem.alias("problem"))


def rebuilt(items: DataFrame, vectors: DataFrame, key: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """vectors (key, vector) with those of the items that lack one, made by embed."""
    lacking = items.join(vectors, key, "left_anti")
    return vectors.select(key, "vector").union(embed(lacking).select(key, "vector"))


def embedded_remotely(texts: DataFrame, client: Callable[[list[str]], list[list[float]]], id_col: str = "id", text_col: str = "text", request: int = REQUEST, requests: int = REQUESTS) -> DataFrame:
    """(id, vector) by a client that takes lists of texts: `request` texts a call, `requests` calls at once
    in each task. Null texts have a null vector and aren't sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(requests) as pool:
            for b in batches:
                texts = b.column("text").to_pylist()
                sent = [i for i, t in enumerate(texts) if t is not None]
                calls = pool.map(client, [[texts[i] for i in sent[a : a + request]] for a in range(0, len(sent), request)])
                out: list[list[float] | None] = [None] * len(texts)
                for i, v in zip(sent, (v for call in calls for v in call), strict=True):
                    out[i] = v
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float32()))], ["id", "vector"])

    df = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return df.mapInArrow(run, f"id {dict(df.dtypes)['id']}, vector array<float>").withColumnRenamed("id", id_col)
