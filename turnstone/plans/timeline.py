"""Queries over version logs: orders of a customer, events as a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import timeline as t
from .tables import micros

_NS = "epoch_us({0}) * 1000"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as revisions of their customer: revision by date and key."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", micros("o_orderdate").alias("us"), F.row_number().over(w).cast("long").alias("revision"))


_ORDERS_SQL = """o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS us,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision FROM orders)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: version = event_id + 1, with times out of order where event_id % 7 = 3."""
    e = table(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 7 == 3, 3_600_000_000).otherwise(0)
    return e.select((F.col("event_id") + 1).alias("version"), "user_id", "event_type", (micros("ts") + late).alias("us"))


_EVENTS_SQL = """e AS (SELECT event_id + 1 AS version, user_id, event_type,
    epoch_us(ts) + CASE WHEN event_id % 7 = 3 THEN 3600000000 ELSE 0 END AS us FROM events)"""


@query("current_state", f"WITH {_ORDERS_SQL} SELECT o_custkey, o_orderkey, o_orderstatus, revision FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY revision DESC) = 1")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.latest(_orders(spark, sf_dir), ["o_custkey"], "revision").select("o_custkey", "o_orderkey", "o_orderstatus", "revision")


@query("version_at_or_before", f"""
    WITH {_EVENTS_SQL}, r AS (SELECT version, max(us) OVER (ORDER BY version) AS top, row_number() OVER (ORDER BY version) AS n FROM e),
    a AS (SELECT DISTINCT epoch_us(date_trunc('day', ts)) AS at FROM events)
    SELECT a.at, max(r.version) AS version FROM a LEFT JOIN r ON r.top <= a.at AND r.version = r.n GROUP BY a.at""")
def version_at_or_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day's beginning, the version that the log had then."""
    at = table(spark, sf_dir, "events").select(F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("at")).distinct()
    return t.versions_at(_events(spark, sf_dir), at, "version", "us")


@query("running_max_time", f"WITH {_EVENTS_SQL} SELECT version, us, max(us) OVER (ORDER BY version) AS top FROM e")
def running_max_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.running_max(_events(spark, sf_dir), "version", "us", "top", chunk=1000).select("version", "us", "top")


@query("first_gap", f"""
    WITH {_EVENTS_SQL}, g AS (SELECT version FROM e WHERE version % 977 <> 0)
    SELECT CAST(min(version) + 1 AS BIGINT) AS missing FROM g WHERE version + 1 NOT IN (SELECT version FROM g)""")
def first_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version that the log lacks, with every 977th taken away."""
    return t.first_gap(_events(spark, sf_dir).where("version % 977 <> 0"), "version", chunk=100)


@query("asof_generation", f"""
    WITH {_ORDERS_SQL}, {_EVENTS_SQL}
    SELECT e.version, e.user_id, o.us AS order_us, o.o_orderkey
    FROM (SELECT version, user_id, us - 157680000000000 AS us FROM e) e
    ASOF LEFT JOIN (SELECT o_custkey, max(us) AS us, max_by(o_orderkey, revision) AS o_orderkey FROM o GROUP BY o_custkey, us) o
    ON e.user_id = o.o_custkey AND e.us >= o.us""")
def asof_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last order at or before it (five years back, where orders are)."""
    orders = _orders(spark, sf_dir)
    last = t.latest(orders, ["o_custkey", "us"], "revision").select(F.col("o_custkey").alias("user_id"), F.col("us").alias("order_us"), "o_orderkey")
    asks = _events(spark, sf_dir).select("version", "user_id", (F.col("us") - 157_680_000_000_000).alias("at"))
    return t.as_of(asks, last, ["user_id"], "at", "order_us", ["o_orderkey"]).select("version", "user_id", "order_us", "o_orderkey")


@query("branch_at", f"""
    WITH {_EVENTS_SQL} SELECT user_id, max(version) AS version, max_by(event_type, version) AS event_type FROM e WHERE version <= (SELECT max(version) // 2 FROM e) GROUP BY user_id""")
def branch_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last revision at the middle version of the log."""
    log = _events(spark, sf_dir)
    half = log.agg(F.expr("max(version) div 2").alias("_half"))  # one row
    return t.latest(log.crossJoin(half).where("version <= _half"), ["user_id"], "version").select("user_id", "version", "event_type")


@query("record_version", f"WITH {_EVENTS_SQL} SELECT version, user_id, us FROM e WHERE version = 42")
def record_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("version = 42").select("version", "user_id", "us")


@query("dense_version_check", f"""
    WITH {_ORDERS_SQL}, k AS (SELECT o_custkey, revision FROM o WHERE o_orderkey % 5 <> 0),
    c AS (SELECT *, coalesce(lag(revision) OVER (PARTITION BY o_custkey ORDER BY revision), 0) + 1 AS expected FROM k)
    SELECT o_custkey, revision, expected FROM c WHERE revision <> expected""")
def dense_version_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions that don't follow, with every order divisible by 5 taken away."""
    log = _orders(spark, sf_dir).where("o_orderkey % 5 <> 0")
    return t.dense_errors(log, ["o_custkey"], "revision").select("o_custkey", "revision", "expected")


@query("version_uniqueness", """
    WITH v AS (SELECT l_orderkey AS version, 'lines' AS log FROM lineitem WHERE l_linenumber = 1
               UNION ALL SELECT o_orderkey, 'orders' FROM orders WHERE o_orderkey % 3 = 0
               UNION ALL SELECT event_id, 'events' FROM events WHERE event_id % 2 = 0)
    SELECT version, count(*) AS times, string_agg(DISTINCT log, ',' ORDER BY log) AS logs FROM v GROUP BY version HAVING count(*) > 1""")
def version_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global versions that several logs use."""
    get = lambda name, c: table(spark, sf_dir, name).withColumn("version", F.col(c))
    logs = {"lines": get("lineitem", "l_orderkey").where("l_linenumber = 1"), "orders": get("orders", "o_orderkey").where("version % 3 = 0"), "events": get("events", "event_id").where("version % 2 = 0")}
    return t.repeated_versions(logs, "version")


@query("source_time_resolution", """
    SELECT d.doc_id, coalesce(e.us, o.us, CASE WHEN d.doc_id % 2 = 0 THEN 0 END, -1) AS source_us
    FROM documents d LEFT JOIN (SELECT event_id, CASE WHEN event_type <> 'view' THEN epoch_us(ts) END AS us FROM events) e ON e.event_id = d.doc_id
    LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN epoch_us(o_orderdate) END AS us FROM orders) o ON o.o_orderkey = d.doc_id""")
def source_time_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known of four sources of a document's time."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.when(F.col("event_type") != "view", micros("ts")).alias("e"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "O", micros("o_orderdate")).alias("o"))
    d = table(spark, sf_dir, "documents").select("doc_id").join(e, "doc_id", "left").join(o, "doc_id", "left")
    return d.select("doc_id", t.first_known(F.col("e"), F.col("o"), F.when(F.col("doc_id") % 2 == 0, 0), F.lit(-1)).cast("long").alias("source_us"))


@query("publish_outcomes", f"""
    WITH {_ORDERS_SQL}, log AS (SELECT * FROM o WHERE revision <= 3),
    inc AS (SELECT o_orderkey, o_custkey, revision, o_orderstatus FROM o WHERE revision BETWEEN 3 AND 5),
    now AS (SELECT o_custkey, max(revision) AS r, max_by(o_orderstatus, revision) AS s FROM log GROUP BY 1)
    SELECT i.o_orderkey, i.o_custkey, i.revision,
           CASE WHEN i.o_orderkey IN (SELECT o_orderkey FROM log) THEN 'repeated' WHEN i.revision <> coalesce(n.r, 0) + 1 THEN 'stale'
                WHEN n.s IS NOT NULL AND n.s IS DISTINCT FROM i.o_orderstatus THEN 'changed' ELSE 'ok' END AS outcome
    FROM inc i LEFT JOIN now n USING (o_custkey)""")
def publish_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions 3 to 5 published on a log that holds 1 to 3; the status must not change."""
    o = _orders(spark, sf_dir)
    out = t.published(o.where("revision <= 3"), o.where("revision between 3 and 5"), ["o_custkey"], "o_orderkey", "revision", "o_orderstatus")
    return out.select("o_orderkey", "o_custkey", "revision", "outcome")


@query("grouped_publish", """
    WITH m AS (SELECT max(event_id) + 1 AS base FROM events)
    SELECT o_orderkey, m.base + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS version FROM orders, m""")
def grouped_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch gets a contiguous range of versions after the log's last."""
    base = table(spark, sf_dir, "events").agg((F.max("event_id") + 1).alias("base"))
    batch = table(spark, sf_dir, "orders")
    # ranks by month, then by date in it: no task orders the whole batch
    month = F.date_trunc("month", "o_orderdate")
    counts = batch.groupBy(month.alias("m")).count()
    before = counts.select("m", F.coalesce(F.sum("count").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("m").orderBy("o_orderdate", "o_orderkey"))
    ranked = batch.withColumn("m", month).withColumn("n", rank).join(F.broadcast(before), "m").crossJoin(F.broadcast(base))  # base: one row
    return ranked.select("o_orderkey", (F.col("base") + F.col("before") + F.col("n")).alias("version"))


@query("revision_changes", f"""
    WITH {_ORDERS_SQL} SELECT o_custkey, revision, o_orderstatus FROM o
    QUALIFY lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY revision) IS DISTINCT FROM o_orderstatus""")
def revision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision that repeats the last status isn't recorded."""
    return t.changes(_orders(spark, sf_dir), ["o_custkey"], "revision", "o_orderstatus").select("o_custkey", "revision", "o_orderstatus")


@query("semantic_cut", """
    SELECT (SELECT max(event_id) FROM events) AS global_version, (SELECT count(*) FROM conversations) AS archive_version, (SELECT max(doc_id) FROM documents) AS memory_version""")
def semantic_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current version of three logs, one row."""
    g = table(spark, sf_dir, "events").agg(F.max("event_id").alias("global_version"))
    a = table(spark, sf_dir, "conversations").agg(F.count("*").alias("archive_version"))
    return g.crossJoin(a).crossJoin(table(spark, sf_dir, "documents").agg(F.max("doc_id").alias("memory_version")))  # one row each


@query("memory_revision", f"""WITH {_ORDERS_SQL} SELECT o_custkey, revision, o_orderkey, o_orderstatus FROM o WHERE revision = 2 AND o_custkey % 10 = 7""")
def memory_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second revision of some statements."""
    asked = table(spark, sf_dir, "customer").where("c_custkey % 10 = 7").select(F.col("c_custkey").alias("o_custkey"), F.lit(2).alias("revision"))
    return t.at_revision(_orders(spark, sf_dir), asked, ["o_custkey"], "revision").select("o_custkey", "revision", "o_orderkey", "o_orderstatus")


@query("publish_memories", f"""
    WITH {_ORDERS_SQL}, log AS (SELECT * FROM o WHERE revision <= 3), inc AS (SELECT * FROM o WHERE revision BETWEEN 3 AND 5), now AS (SELECT o_custkey, max(revision) AS r, max_by(o_orderstatus, revision) AS s FROM log GROUP BY 1)
    SELECT o_custkey, count(*) AS revisions, max(revision) AS last FROM (SELECT o_custkey, revision FROM log UNION ALL SELECT i.o_custkey, i.revision FROM inc i LEFT JOIN now n USING (o_custkey)
        WHERE i.o_orderkey NOT IN (SELECT o_orderkey FROM log) AND i.revision = coalesce(n.r, 0) + 1 AND (n.s IS NULL OR n.s = i.o_orderstatus)) GROUP BY 1""")
def publish_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after revisions 3 to 5 were published on 1 to 3: what is new and fits is appended."""
    o = _orders(spark, sf_dir)
    log = t.appended(o.where("revision <= 3"), o.where("revision between 3 and 5"), ["o_custkey"], "o_orderkey", "revision", "o_orderstatus")
    return log.groupBy("o_custkey").agg(F.count("*").alias("revisions"), F.max("revision").alias("last"))
