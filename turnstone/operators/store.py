"""Stores as folders of tables: listing, opening with checks, revisions of branches, titles and states,
links of files, snapshots, copies that are promoted when they are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeline import latest

#: Values of a temporal status (a rule of the operator).
STATUSES = ("current", "future", "historical")


def chunks(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(table, key, bytes): every record of a store, with the size of its content as JSON."""
    parts = [df.select(F.lit(name).alias("table"), F.concat_ws(":", *keys[name]).alias("key"), F.octet_length(F.to_json(F.struct(*df.columns))).cast("long").alias("bytes")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def opened(tables: dict[str, DataFrame], keys: dict[str, list[str]], references: list[tuple[str, str, str, str]]) -> DataFrame:
    """(table, rows, repeated_keys, null_keys, dangling): what opening a store checks, a row a table.
    references: (table, column, target table, target column); null columns refer to nothing."""
    counts = []
    for name, df in tables.items():
        none = F.lit(False)
        for k in keys[name]:
            none |= F.col(k).isNull()
        one = df.groupBy(*keys[name]).agg(F.count("*").alias("_n")).agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.when(none, F.col("_n"))), F.lit(0)).alias("null_keys")
        )
        counts.append(one.select(F.lit(name).alias("table"), "rows", "repeated_keys", "null_keys"))
    dangling = []
    for name, column, target, to in references:
        there = tables[target].select(F.col(to).alias(column)).distinct()
        dangling.append(tables[name].where(F.col(column).isNotNull()).join(there, column, "left_anti").agg(F.lit(name).alias("table"), F.count("*").alias("n")))
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    if not dangling:
        return out.withColumn("dangling", F.lit(0).cast("long"))
    lost = dangling[0]
    for d in dangling[1:]:
        lost = lost.union(d)
    lost = lost.groupBy("table").agg(F.sum("n").alias("dangling"))
    return out.join(lost, "table", "left").select("table", "rows", "repeated_keys", "null_keys", F.coalesce("dangling", F.lit(0)).alias("dangling"))


def branch_revisions(current: DataFrame, proposed: DataFrame, ancestors: DataFrame) -> DataFrame:
    """proposed (branch, leaf) with outcome: `new` (no such branch), `same` leaf, `extends` (the new leaf
    descends from the old one) or `rejected`. ancestors: (leaf, id), each leaf's path, itself included."""
    old = current.select("branch", F.col("leaf").alias("_old"))
    on_path = ancestors.select("leaf", F.col("id").alias("_old"), F.lit(True).alias("_on"))
    judged = proposed.join(old, "branch", "left").join(on_path, ["leaf", "_old"], "left")
    outcome = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("leaf"), "same").when(F.col("_on"), "extends").otherwise("rejected")
    return judged.select(*proposed.columns, outcome.alias("outcome"))


def status_updates(current: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (id, status) with outcome and next revision: `unknown` id, `invalid` value, `equal` (no
    revision is written) or `written`. current: (id, revision, status)."""
    now = current.select("id", F.col("revision").alias("_r"), F.col("status").alias("_s"))
    joined = updates.join(now, "id", "left")
    outcome = F.when(F.col("_r").isNull(), "unknown").when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "invalid").when(F.col("_s").eqNullSafe(F.col("status")), "equal").otherwise("written")
    return joined.withColumn("outcome", outcome).select(*updates.columns, "outcome", F.when(F.col("outcome") == "written", F.col("_r") + 1).alias("revision"))


def titled(conversations: DataFrame, metadata: DataFrame) -> DataFrame:
    """conversations (conversation_id) with the last title and active flag of the log metadata
    (conversation_id, version, title, active); without a row: no title, active."""
    last = latest(metadata, ["conversation_id"], "version").select("conversation_id", "title", "active")
    return conversations.join(last, "conversation_id", "left").select(*conversations.columns, "title", F.coalesce("active", F.lit(True)).alias("active"))


def linked_files(files: DataFrame, sources: DataFrame, memories: DataFrame) -> DataFrame:
    """(owner_kind, owner, place, file_id, filename): the files (file_id, filename) of source turns
    (owner, file_ids in order) and of statements (owner, file_id), the latter by file id."""
    of_sources = sources.select(F.lit("source").alias("owner_kind"), "owner", F.posexplode("file_ids").alias("place", "file_id"))
    order = F.row_number().over(Window.partitionBy("owner").orderBy("file_id")) - 1
    of_memories = memories.distinct().select(F.lit("memory").alias("owner_kind"), "owner", order.alias("place"), "file_id")
    return of_sources.union(of_memories).join(files.select("file_id", "filename"), "file_id").select("owner_kind", "owner", "place", "file_id", "filename")


def snapshot(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, key, body): all parts of the knowledge of an owner (key, ...) as one table of JSON rows."""
    rows = [df.select(F.lit(name).alias("part"), F.col("key").cast("string").alias("key"), F.to_json(F.struct(*(c for c in df.columns if c != "key"))).alias("body")) for name, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def episode_bounds(episodes: DataFrame, key: str, boundary: str, closed_at: int) -> DataFrame:
    """episodes (key, episode, first_ns, last_ns) with boundary and finalized_ns: all but the last end by
    `size` when the next begins; the last ends by `boundary` at closed_at; none before its last turn."""
    nxt = F.lead("first_ns").over(Window.partitionBy(key).orderBy("episode"))
    at = F.greatest(F.coalesce("_next", F.lit(closed_at)), "last_ns")
    return episodes.withColumn("_next", nxt).withColumn("boundary", F.when(F.col("_next").isNotNull(), "size").otherwise(boundary)).withColumn("finalized_ns", at).drop("_next")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that doesn't depend on the order of rows."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def promoted(df: DataFrame, path: str) -> DataFrame:
    """df written to the folder path in place of what is there, and read again.

    The table is written beside it, its fingerprint compared with df's, and only then are the folders
    renamed; the old one stays as a backup until the new one has been opened, and comes back if that
    fails.
    """
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    written = spark.read.schema(df.schema).parquet(new)
    if fingerprint(written).first() != fingerprint(df).first():
        fs.delete(place(new), True)
        raise ValueError(f"{new}: not the rows that were to be written")
    had = fs.exists(place(path))
    if had and not fs.rename(place(path), place(old)):
        raise OSError(f"{path} can't be set aside")
    try:
        if not fs.rename(place(new), place(path)):
            raise OSError(f"{new} can't be renamed")
        out = spark.read.schema(df.schema).parquet(path)
        out.limit(1).count()
    except Exception:
        fs.delete(place(path), True)
        if had:
            fs.rename(place(old), place(path))
        raise
    if had:
        fs.delete(place(old), True)
    return out
