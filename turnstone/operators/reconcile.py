"""Two replicas of a log: common prefix, verdict, tails to replay, conflicts of kinds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .order import numbered


def compared(left: DataFrame, right: DataFrame, key: list[str], position: str, digest: str) -> DataFrame:
    """(key..., verdict, prefix, left_length, right_length): the logs agree on positions up to prefix.

    A full outer join by position; the first position where digests differ ends the prefix.
    """
    on = [*key, position]
    both = left.select(*on, F.col(digest).alias("l")).join(right.select(*on, F.col(digest).alias("r")), on, "full_outer")
    differs = ~F.col("l").eqNullSafe(F.col("r"))
    sums = both.groupBy(*key).agg(
        F.min(F.when(differs, F.col(position))).alias("first"), F.count("l").alias("left_length"), F.count("r").alias("right_length"), F.max(position).alias("end")
    )
    prefix = F.coalesce(F.col("first"), F.col("end") + 1)
    verdict = (
        F.when(F.col("first").isNull(), "identical")
        .when(prefix >= F.col("right_length"), "left extends")
        .when(prefix >= F.col("left_length"), "right extends")
        .otherwise("diverged")
    )
    return sums.select(*key, verdict.alias("verdict"), prefix.alias("prefix"), "left_length", "right_length")


def tail(log: DataFrame, verdicts: DataFrame, key: list[str], position: str) -> DataFrame:
    """The rows of a log past the common prefix."""
    return log.join(verdicts.select(*key, "prefix"), key).where(F.col(position) >= F.col("prefix")).drop("prefix")


def replayed(left: DataFrame, right_tail: DataFrame, key: list[str], position: str, identity: str) -> DataFrame:
    """Rows of the right tail that the left log lacks by identity, at the positions after its end."""
    fresh = right_tail.join(left.select(*key, identity), [*key, identity], "left_anti")
    ends = left.groupBy(*key).agg((F.max(position) + 1).alias("end"))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(position)) - 1
    return fresh.withColumn("_n", n).join(ends, key, "left").withColumn(position, F.coalesce("end", F.lit(0)) + F.col("_n")).drop("_n", "end")


def incompatible_states(left: DataFrame, right: DataFrame, key: list[str], order: str, state: str) -> DataFrame:
    """(key..., left_states, right_states) of keys whose state sequences are no prefixes of each other."""
    listed = lambda df, name: df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, state))), lambda s: s[state]).alias(name))
    both = listed(left, "left_states").join(listed(right, "right_states"), key)
    n = F.least(F.size("left_states"), F.size("right_states"))
    return both.where((n > 0) & (F.slice("left_states", 1, n) != F.slice("right_states", 1, n)))


def conflicts(left: DataFrame, right: DataFrame, key: list[str], fixed: list[str]) -> DataFrame:
    """(kind, key..., field): rows of one key in both whose fixed columns differ, and those in one only."""
    l, r = left.select(*key, *(F.col(c).alias(f"l_{c}") for c in fixed), F.lit(1).alias("_l")), right.select(*key, *(F.col(c).alias(f"r_{c}") for c in fixed), F.lit(1).alias("_r"))
    both = l.join(r, key, "full_outer")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("_l").isNull(), F.struct(F.lit("only right").alias("kind"), F.lit("").alias("field"))),
            F.when(F.col("_r").isNull(), F.struct(F.lit("only left").alias("kind"), F.lit("").alias("field"))),
            *(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.struct(F.lit("differs").alias("kind"), F.lit(c).alias("field"))) for c in fixed),
        )
    )
    return both.select(*key, F.explode(kinds).alias("k")).select("k.kind", *key, "k.field")


#: Tables whose rows of one key must be equal, and the kind of the conflict if they aren't.
RECORD_KINDS = ("source_turn", "branch", "episode", "fragment", "file", "insomnia_completion")
#: Graph logs, and the kind of the conflict if an edge's states contradict each other.
GRAPH_KINDS = ("graph_relation", "semantic_graph_relation")


def all_conflicts(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """(kind, key): what keeps two stores from being reconciled.

    left, right: tables by kind. RECORD_KINDS: (key, content). `memory`: (id, revision, mutation, body);
    gives memory_mutation (one mutation, two contents), memory_semantic_mutation (a body that isn't the
    one the statement has on the left) and memory_revision (an incoming revision that neither is there
    nor follows the last). GRAPH_KINDS: (key, version, state).
    """
    found = []
    add = lambda df, kind, key="key": found.append(df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key")).distinct())
    for kind in RECORD_KINDS:
        if kind in left and kind in right:
            both = left[kind].select("key", F.col("content").alias("_l")).join(right[kind].select("key", F.col("content").alias("_r")), "key")
            add(both.where(~F.col("_l").eqNullSafe(F.col("_r"))), kind)
    if "memory" in left and "memory" in right:
        l, r = left["memory"], right["memory"]
        same = l.select("mutation", F.struct("id", "revision", "body").alias("_l")).join(r.select("mutation", F.col("id").alias("key"), F.struct("id", "revision", "body").alias("_r")), "mutation")
        add(same.where(~F.col("_l").eqNullSafe(F.col("_r"))), "memory_mutation")
        fresh = r.join(l.select("mutation"), "mutation", "left_anti")
        now = l.groupBy("id").agg(F.max("revision").alias("_now"), F.max_by("body", "revision").alias("_body"))
        placed = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("revision"))).join(now, "id", "left")
        add(placed.where(F.col("_body").isNotNull() & ~F.col("_body").eqNullSafe(F.col("body"))), "memory_semantic_mutation", "id")
        add(placed.where(F.col("revision") != F.coalesce("_now", F.lit(0)) + F.col("_n")), "memory_revision", "id")
    for kind in GRAPH_KINDS:
        if kind in left and kind in right:
            add(incompatible_states(left[kind], right[kind], ["key"], "version", "state"), kind)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def replayed_revisions(left: DataFrame, tail: DataFrame) -> DataFrame:
    """tail rows (id, revision, mutation, ...) with outcome: `duplicate` (the left log has the mutation),
    `replayed` (it follows the last revision of the left log and the tail's before it) or `conflict`."""
    now = left.groupBy("id").agg(F.max("revision").alias("_now"))
    known = left.select("mutation").distinct().withColumn("_known", F.lit(True))
    judged = tail.join(known, "mutation", "left").join(now, "id", "left")
    fresh = F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).over(Window.partitionBy("id").orderBy("revision"))
    outcome = F.when(F.col("_known"), "duplicate").when(F.col("revision") == F.coalesce("_now", F.lit(0)) + F.col("_fresh"), "replayed").otherwise("conflict")
    return judged.withColumn("_fresh", fresh).withColumn("outcome", outcome).select(*tail.columns, "outcome")


def replayed_entities(entities: DataFrame, tombstones: DataFrame, tail: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revisions with outcome, tombstones): the tail (id, revision, mutation) of entities as
    replayed_revisions, `retired` where the left store or the tail itself (dead) has a tombstone (id);
    and the tombstones (id, replacement_id) of the tail that the left store lacks."""
    gone = tombstones.select("id").union(dead.select("id")).distinct().withColumn("_gone", F.lit(True))
    rows = replayed_revisions(entities, tail).join(gone, "id", "left")
    outcome = F.when(F.col("_gone") & (F.col("outcome") != "duplicate"), "retired").otherwise(F.col("outcome"))
    return rows.withColumn("outcome", outcome).drop("_gone"), dead.join(tombstones.select("id"), "id", "left_anti")


def replayed_graph(left: DataFrame, tail: DataFrame, key: list[str]) -> DataFrame:
    """The tail's mutations (key..., version, active) that change an edge of the left log, with the versions
    that they get after its last; repeated states are no-ops."""
    now = left.groupBy(*key).agg(F.max_by("active", "version").alias("_now"))
    before = F.lag("active").over(Window.partitionBy(*key).orderBy("version"))
    rows = tail.withColumn("_before", before).join(now, key, "left")
    real = rows.where(F.col("active") != F.coalesce("_before", "_now", F.lit(False)))
    last = left.agg(F.max("version").alias("_last"))  # one row
    # places in chunks of versions, so that no task orders the whole tail
    chunk = F.expr("version div 65536")
    sizes = real.groupBy(chunk.alias("_c")).agg(F.count("*").alias("_n"))
    ahead = sizes.select("_c", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))  # a row a chunk
    place = F.row_number().over(Window.partitionBy("_c").orderBy("version", *key))
    numbered = real.withColumn("_c", chunk).withColumn("_k", place).join(ahead, "_c").crossJoin(last)
    return numbered.select(*key, "active", (F.coalesce("_last", F.lit(0)) + F.col("_ahead") + F.col("_k")).alias("version"))


# -- whole stores -----------------------------------------------------------------------------

#: Tables of a store, in the order in which a tail is replayed: what others refer to comes first. Each
#: row has the position that its record has in the store's one log.
STORE = {
    "turns": ["id", "content"],
    "memories": ["id", "revision", "mutation", "body"],
    "entities": ["id", "revision", "mutation", "body"],
    "tombstones": ["id", "replacement_id"],
    "relations": ["source", "target", "kind", "active"],
    "links": ["file_id", "memory_id"],
}
#: Positions that have one digest.
CHUNK = 4096


def store_log(store: dict[str, DataFrame]) -> DataFrame:
    """(position, digest) of all records of a store."""
    parts = [store[t].select("position", F.sha2(F.concat(F.lit(t), F.to_json(F.struct(*columns))), 256).alias("digest")) for t, columns in STORE.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def chunk_digests(log: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, digest, n): one digest for each stretch of `size` positions. A store can keep them."""
    listed = F.sort_array(F.collect_list(F.struct("position", "digest")))
    return log.groupBy(F.expr(f"position DIV {size}").alias("chunk")).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["digest"]), ""), 256).alias("digest"), F.count("*").alias("n"))


def compared_logs(left: DataFrame, right: DataFrame, size: int = CHUNK) -> tuple[str, int, int, int]:
    """(relation, common, left_length, right_length) of two logs (position, digest) without gaps.

    Digests of chunks tell the first chunk that differs; only that one is compared by position. A few
    numbers go to the driver.
    """
    l, r = cut(chunk_digests(left, size), "chunks"), cut(chunk_digests(right, size), "chunks")
    n, m = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (l, r))
    both = l.join(r.withColumnsRenamed({"digest": "other", "n": "m"}), "chunk", "full_outer")
    first = both.where(~F.col("digest").eqNullSafe(F.col("other"))).agg(F.min("chunk")).first()[0]
    common = n
    if first is not None:
        here = lambda df: df.where(F.col("position").between(first * size, first * size + size - 1))
        pairs = here(left).join(here(right).withColumnRenamed("digest", "other"), "position", "full_outer")
        common = pairs.where(~F.col("digest").eqNullSafe(F.col("other"))).agg(F.min("position")).first()[0]
    relation = "identical" if common == n == m else "left extends" if common == m else "right extends" if common == n else "diverged"
    return relation, common, n, m


def graph_tail(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """right with outcome. Of two tails (key..., position, active) of one edge one is the beginning of the
    other, or they conflict: so what the left one has as many of is a `duplicate`, the rest `replayed`."""
    had = left.groupBy(*key).agg(F.count("*").alias("_had"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("position"))
    rows = right.withColumn("_k", place).join(had, key, "left")
    return rows.withColumn("outcome", F.when(F.col("_k") <= F.coalesce("_had", F.lit(0)), "duplicate").otherwise("replayed")).drop("_k", "_had")


def _unlike(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """right with outcome: duplicate if left has the key, or right had it before."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("position")) > 1
    known = left.select(key).distinct().withColumn("_known", F.lit(True))
    return right.withColumn("_again", first).join(known, key, "left").withColumn("outcome", F.when(F.col("_again") | F.col("_known").isNotNull(), "duplicate").otherwise("replayed")).drop("_again", "_known")


def store_conflicts(left: dict[str, DataFrame], right_tail: dict[str, DataFrame], left_tail: dict[str, DataFrame]) -> DataFrame:
    """(kind, key) of what keeps the right store's tail from being replayed."""
    edge = F.concat_ws(":", "source", "target", "kind").alias("key")
    states = lambda df: df.select(edge, F.col("position").alias("version"), F.col("active").cast("string").alias("state"))
    record = lambda df: df.select(F.col("id").alias("key"), "content")
    alive = right_tail["entities"].join(left["tombstones"].select("id").union(right_tail["tombstones"].select("id")), "id", "left_anti")
    memory = lambda df: df.select("id", "revision", "mutation", "body")
    found = all_conflicts({"source_turn": record(left["turns"]), "memory": memory(left["memories"]), "graph_relation": states(left_tail["relations"])}, {"source_turn": record(right_tail["turns"]), "memory": memory(right_tail["memories"]), "graph_relation": states(right_tail["relations"])})
    # the body of an entity may change with a revision, so only its mutations and revisions can clash
    judged = replayed_revisions(left["entities"].select("id", "revision", "mutation"), alive.select("id", "revision", "mutation"))
    return found.union(judged.where("outcome = 'conflict'").select(F.lit("entity_revision"), F.col("id").cast("string")).distinct())


def reconciled_stores(left: dict[str, DataFrame], right: dict[str, DataFrame], size: int = CHUNK) -> tuple[dict[str, DataFrame] | None, dict[str, object], DataFrame | None]:
    """(store, report, conflicts): one store of what both have. Tables are those of STORE, with position.

    Where one log extends the other, the longer store is the result. Of diverged ones the left is kept
    as it is, and the right one's records after the common beginning are put onto it, table by table:
    what the left store has already is a duplicate, revisions of retired entities fall, the rest gets
    the positions after the left log's end. With conflicts there is no store. report: the relation,
    lengths, and how many rows were replayed, duplicate or retired in each table.
    """
    relation, common, n, m = compared_logs(store_log(left), store_log(right), size)
    report: dict[str, object] = {"relation": relation, "common": common, "left_length": n, "right_length": m, "change_required": relation == "right extends"}
    if relation != "diverged":
        return (right if relation == "right extends" else left), report, None
    past: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] = lambda store: {t: df.where(F.col("position") >= common) for t, df in store.items()}
    mine, theirs = past(left), past(right)
    conflicts_ = cut(store_conflicts(left, theirs, mine), "conflicts")
    if not conflicts_.isEmpty():
        return None, report, conflicts_
    edge = ["source", "target", "kind"]
    pair = F.concat_ws(":", "file_id", "memory_id")
    entities, _ = replayed_entities(left["entities"], left["tombstones"], theirs["entities"], theirs["tombstones"])
    judged = {
        "turns": _unlike(left["turns"], theirs["turns"], "id"),
        "memories": replayed_revisions(left["memories"], theirs["memories"]),
        "entities": entities,
        "tombstones": _unlike(left["tombstones"], theirs["tombstones"], "id"),
        "relations": graph_tail(mine["relations"], theirs["relations"], edge),
        "links": _unlike(left["links"].withColumn("_pair", pair), theirs["links"].withColumn("_pair", pair), "_pair").drop("_pair"),
    }
    judged = {t: cut(df, t) for t, df in judged.items()}
    tag: Callable[[str], Column] = lambda t: F.lit(list(STORE).index(t)).alias("_table")
    fresh = None
    for t, df in judged.items():
        rows = df.where("outcome = 'replayed'").select(tag(t), F.col("position").alias("_from"))
        fresh = rows if fresh is None else fresh.union(rows)
    places = cut(numbered(fresh, ["_table", "_from"], "_place"), "places")
    store = {}
    for t, columns in STORE.items():
        here = places.where(F.col("_table") == tag(t)).select("_from", "_place")
        new = judged[t].where("outcome = 'replayed'").join(here, F.col("position") == F.col("_from")).select(*columns, (F.col("_place") + n).alias("position"))
        store[t] = left[t].select(*columns, "position").union(new)
    counts = None
    for t, df in judged.items():
        one = df.groupBy("outcome").count().select(F.lit(t).alias("t"), "outcome", "count")
        counts = one if counts is None else counts.union(one)
    for r in counts.collect():  # at most three rows a table
        report[f"{r['outcome']} {r['t']}"] = r["count"]
    report["change_required"] = any(k.startswith("replayed") for k in report)
    return store, report, None
