"""Queries of duplicate chains, life cycle and work order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import lifecycle as l
from .tables import micros


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies: each document and the first with its text."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("a")), "h").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))


@query("duplicate_chain", """
    WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS component, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text IS NOT NULL)
    SELECT component, lag(doc_id) OVER (PARTITION BY component ORDER BY doc_id % 100, doc_id) AS earlier, doc_id AS later FROM d WHERE n > 1
    QUALIFY earlier IS NOT NULL""")
def duplicate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies in the order of a made-up time, the document's number modulo 100."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100).alias("time"))
    return l.duplicate_chain(_pairs(spark, sf_dir), items)


@query("supersession", """
    WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'extracted' ELSE 'knowledge' END AS state, o_orderpriority LIKE '1%' AS explicit FROM orders),
    s AS (SELECT o_orderkey AS newer, o_orderkey - 7 AS older FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT o_orderkey, o_orderkey - 16 FROM orders WHERE o_orderkey % 18 = 0),
    v AS (SELECT older AS id, count(DISTINCT newer) AS n, min(newer) AS newer FROM s GROUP BY older),
    a AS (SELECT l_orderkey AS id, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
    SELECT i.id, state, explicit, CASE WHEN v.n IS NOT NULL THEN 'archived' WHEN state = 'extracted' AND i.id % 13 = 0 THEN 'archived'
           WHEN explicit OR a.n >= 2 THEN 'canonical' WHEN state = 'extracted' THEN 'knowledge' ELSE state END AS next, CASE WHEN v.n = 1 THEN v.newer END AS superseded_by
    FROM i LEFT JOIN v USING (id) LEFT JOIN a USING (id)""")
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items: some supersede earlier ones, lines with many pieces are anchors."""
    o = table(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "extracted").otherwise("knowledge").alias("state"), F.col("o_orderpriority").startswith("1").alias("explicit"))
    key = F.col("o_orderkey")
    over = o.where(key % 9 == 0).select(key.alias("newer"), (key - 7).alias("older")).union(o.where(key % 18 == 0).select(key, key - 16))
    anchors = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("anchor"))
    return l.projected(items, over, items.where("id % 13 = 0").select("id"), anchors)


@query("eligibility", """
    WITH x AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'extracted' ELSE 'knowledge' END AS state, epoch_us(ts) // 1000000 AS s,
                      CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) // 1000000 END AS source, CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts) // 1000000 + (event_id % 40) * 86400 END AS processed FROM events)
    SELECT event_id, state = 'extracted' OR processed IS NULL OR CASE WHEN source IS NOT NULL
           THEN greatest(0, 1707955200 - source) // 2592000 > greatest(0, processed - source) // 2592000 ELSE 1707955200 - processed >= 2592000 END AS due FROM x""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is due for reprocessing on 15 February 2024."""
    ev = table(spark, sf_dir, "events").withColumn("s", F.expr("1").cast("long") * F.floor(micros("ts") / 1_000_000))
    i = F.col("event_id")
    x = ev.select(i, F.when(F.col("event_type") == "view", "extracted").otherwise("knowledge").alias("state"), F.when(i % 3 != 0, F.col("s")).alias("source"), F.when(i % 4 != 0, F.col("s") + (i % 40) * l.DAY).alias("processed"))
    return x.select("event_id", l.eligible(F.col("state"), F.lit(1_707_955_200), F.col("source"), F.col("processed")).alias("due"))


_WORK_SQL = """w AS (SELECT event_id, CAST(user_id % 3 AS BIGINT) AS priority, epoch_us(ts) // 86400000000 AS source_time,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'complete' END AS state,
    event_id % 100 AS lease_until, event_id % 70 AS retry_after FROM events)"""


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, i = table(spark, sf_dir, "events"), F.col("event_id")
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "error", "failed").otherwise("complete")
    return ev.select(i, (F.col("user_id") % 3).alias("priority"), F.floor(micros("ts") / 86_400_000_000).alias("source_time"), state.alias("state"), (i % 100).alias("lease_until"), (i % 70).alias("retry_after"))


@query("work_claim_order", f"""WITH {_WORK_SQL} SELECT event_id, priority, source_time, row_number() OVER (ORDER BY priority, source_time, event_id) AS place FROM w
    WHERE state = 'pending' OR (state = 'processing' AND lease_until <= 50) OR (state = 'failed' AND retry_after <= 50)""")
def work_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.claim_order(_work(spark, sf_dir), ["event_id"], 50).select("event_id", "priority", "source_time", "place")


@query("work_state_counts", f"""WITH {_WORK_SQL} SELECT count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'processing') AS processing,
    count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'complete') AS complete, count(*) FILTER (WHERE state = 'terminal') AS terminal FROM w""")
def work_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.state_counts(_work(spark, sf_dir), ["pending", "processing", "failed", "complete", "terminal"])
