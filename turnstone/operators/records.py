"""Records around conversations and statements: echoes, compactions, files, provenance, status, mentions."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import latest


def sequence_conflicts(events: DataFrame, key: list[str], sequence: str, content: list[str]) -> DataFrame:
    """(key..., sequence, versions): sequences that hold different contents; equal repeats are fine."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return events.groupBy(*key, sequence).agg(F.count_distinct(digest).alias("versions")).where("versions > 1")


def live_compactions(compactions: DataFrame, key: str, through: str, generation: str) -> DataFrame:
    """The record of the largest generation of each (conversation, through message)."""
    return latest(compactions, [key, through], generation)


def with_provenance(memories: DataFrame, episodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """memories (id, episode_id, source_node_id) with the episode's conversation, the source's role and
    time, and problem: a half-given pair, or a reference without a target."""
    e = episodes.select("episode_id", "conversation_id", "through_ns")
    n = nodes.select(F.col("id").alias("source_node_id"), F.col("role").alias("source_role"), F.col("timestamp_ns").alias("source_ns"))
    out = memories.join(e, "episode_id", "left").join(n, "source_node_id", "left")
    problem = (
        F.when(F.col("episode_id").isNull() != F.col("source_node_id").isNull(), "incomplete")
        .when(F.col("episode_id").isNotNull() & F.col("conversation_id").isNull(), "no episode")
        .when(F.col("source_node_id").isNotNull() & F.col("source_role").isNull(), "no turn")
        .otherwise("")
    )
    return out.withColumn("problem", problem)


def pending_status(pending: dict[str, DataFrame], owner: str) -> DataFrame:
    """(owner, <lane>..., quiet): how many rows wait in each lane for each owner, and whether none does."""
    parts = [df.select(F.col(owner), F.lit(name).alias("lane")) for name, df in pending.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    counts = rows.groupBy(owner).agg(*(F.count_if(F.col("lane") == name).alias(name) for name in pending))
    return counts.withColumn("quiet", sum((F.col(n) for n in pending), F.lit(0)) == 0)


def most_specific(mentions: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Mentions that no longer mention of their key contains; of equal spans the first id stays.

    In the order of starts (longer first), a span is contained exactly if an earlier one ends at or
    after its end: a running maximum instead of a self-join.
    """
    order = Window.partitionBy(*key).orderBy(start, F.desc(end), "id").rowsBetween(Window.unboundedPreceding, -1)
    return mentions.withColumn("_reach", F.max(end).over(order)).where(F.col("_reach").isNull() | (F.col("_reach") < F.col(end))).drop("_reach")


def retry_needed(state: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, retry): pending rows whose candidate or context fingerprint has changed since."""
    both = state.join(now.select(key, F.col("candidates").alias("_c"), F.col("context").alias("_x")), key)
    changed = (F.col("status") == "pending") & ~(F.col("candidates").eqNullSafe(F.col("_c")) & F.col("context").eqNullSafe(F.col("_x")))
    return both.select(key, changed.alias("retry"))


def identifier(domain: str, *parts: Column) -> Column:
    """A digest of a domain and parts, each with its length before it."""
    sized = [F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]
    return F.sha2(F.concat(F.lit(f"{domain}/"), *sized), 256)


def bounded_documents(docs: DataFrame, key: str, priority: str, text: str, most: int) -> DataFrame:
    """Documents of a key by priority while their characters fit together; later ones are left out."""
    used = F.sum(F.char_length(text)).over(Window.partitionBy(key).orderBy(priority, text).rowsBetween(Window.unboundedPreceding, 0))
    return docs.withColumn("used", used).where(F.col("used") <= most)


def truncated(text: Column, most: int) -> Column:
    """At most so many bytes of UTF-8, without a broken character at the end."""
    raw = text.cast("binary")  # a character has at most four bytes: one of four cuts ends with one
    cuts = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(4, most + 1))]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*cuts))


def embedded(texts: DataFrame, id_col: str, text_col: str, dimensions: int = 64, seed: str = "0") -> DataFrame:
    """(id, vector): a stand-in for a model: unit vectors from digests of the text, always the same."""

    def vector(text: str) -> np.ndarray:
        n = -(-dimensions // 8)
        raw = b"".join(hashlib.sha256(f"{seed}/{k}/{text}".encode()).digest() for k in range(n))
        v = np.array(struct.unpack(f"<{8 * n}i", raw)[:dimensions], dtype=np.float64)
        return (v / max(np.linalg.norm(v), 1e-300)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [None if t is None else vector(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(vectors, pa.list_(pa.float32()))], ["id", "vector"])

    df = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return df.mapInArrow(run, f"id {dict(df.dtypes)['id']}, vector array<float>").withColumnRenamed("id", id_col)


def inherited_names(continuations: DataFrame, names: DataFrame, least: int = 750) -> DataFrame:
    """(community, name) of the next generation: names (community, name, source) pass along continuations
    (old, new, jaccard): a user's always, a model's if the Jaccard is at least so many thousandths."""
    moved = continuations.join(names.withColumnRenamed("community", "old"), "old")
    return moved.where((F.col("source") == "user") | (F.col("jaccard") >= least)).select(F.col("new").alias("community"), "name")


def statistics(stores: dict[str, tuple[DataFrame, list[str], Column]]) -> DataFrame:
    """(store, rows, distinct_rows, flagged) of stores: their table, the columns that tell rows apart, and a
    condition."""
    parts = [df.agg(F.lit(name).alias("store"), F.count("*").alias("rows"), F.count_distinct(*key).alias("distinct_rows"), F.count_if(flag).alias("flagged")) for name, (df, key, flag) in stores.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def parsed(answers: DataFrame, column: str, schema: str) -> DataFrame:
    """answers with the fields of a JSON column by a schema, and state: `ok`, or `invalid` for what isn't JSON
    or lacks a field."""
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    read = answers.withColumn("_j", F.from_json(column, schema))
    whole = F.col("_j").isNotNull()
    for f in fields:
        whole &= F.col(f"_j.{f}").isNotNull()
    return read.select(*answers.columns, *(F.when(whole, F.col(f"_j.{f}")).alias(f) for f in fields), F.when(whole, "ok").otherwise("invalid").alias("state"))


def current_documents(log: DataFrame, most: int) -> DataFrame:
    """(id, priority, text, used): the last revisions (id, version, deleted, priority, text) that aren't
    deleted, by priority and id while their characters fit into `most`."""
    now = latest(log, ["id"], "version").where("not deleted").select("id", "priority", "text")
    # only what can fit is ordered in one task: no more documents than characters, each priority's first
    size = F.char_length("text")
    near = now.where(size <= most).orderBy("priority", "id").limit(most + 1)
    first_large = now.where(size > most).agg(F.min(F.struct("priority", "id")).alias("_stop"))  # one row: nothing after it fits
    used = F.sum(size).over(Window.orderBy("priority", "id").rowsBetween(Window.unboundedPreceding, 0))
    before = near.crossJoin(first_large).where(F.col("_stop").isNull() | (F.struct("priority", "id") < F.col("_stop"))).drop("_stop")
    return before.withColumn("used", used).where(F.col("used") <= most)
