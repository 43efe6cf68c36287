"""Queries over records: echoes, compactions, provenance, status, mentions, documents by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import communities
from ..operators import records as r
from .communities import _GENERATIONS_SQL, _generations
from .tables import TURNS_SQL, turns


@query("echo_conflicts", """
    WITH e AS (SELECT user_id, event_id % 40 AS sequence, event_type FROM events)
    SELECT user_id, sequence, count(DISTINCT event_type) AS versions FROM e GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1""")
def echo_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("sequence"), "event_type")
    return r.sequence_conflicts(e, ["user_id"], "sequence", ["event_type"])


@query("compactions", """
    WITH c AS (SELECT user_id, event_id % 5 AS through, event_id AS generation, event_type AS summary FROM events)
    SELECT user_id, through, max(generation) AS generation, max_by(summary, generation) AS summary FROM c GROUP BY 1, 2""")
def compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5).alias("through"), F.col("event_id").alias("generation"), F.col("event_type").alias("summary"))
    return r.live_compactions(c, "user_id", "through", "generation")


@query("memory_provenance", f"""
    WITH {TURNS_SQL}, m AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 130 END AS episode_id, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 110) || ':' || (doc_id % 9) END AS source_node_id FROM documents),
    e AS (SELECT conversation_id AS episode_id, conversation_id, max(timestamp_ns) AS through_ns FROM turns GROUP BY 1, 2)
    SELECT doc_id, e.conversation_id, n.role AS source_role, n.timestamp_ns AS source_ns, CASE WHEN (m.episode_id IS NULL) <> (m.source_node_id IS NULL) THEN 'incomplete'
           WHEN m.episode_id IS NOT NULL AND e.conversation_id IS NULL THEN 'no episode' WHEN m.source_node_id IS NOT NULL AND n.role IS NULL THEN 'no turn' ELSE '' END AS problem
    FROM m LEFT JOIN e ON e.episode_id = m.episode_id LEFT JOIN turns n ON n.id = m.source_node_id""")
def memory_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as statements of episodes (conversations) and turns, some of which are missing."""
    i, t = F.col("doc_id"), turns(spark, sf_dir)
    m = table(spark, sf_dir, "documents").select(i, F.when(i % 4 != 0, i % 130).alias("episode_id"), F.when(i % 5 != 0, F.concat_ws(":", i % 110, i % 9)).alias("source_node_id"))
    e = t.groupBy(F.col("conversation_id").alias("episode_id"), "conversation_id").agg(F.max("timestamp_ns").alias("through_ns"))
    return r.with_provenance(m, e, t).select("doc_id", "conversation_id", "source_role", "source_ns", "problem")


@query("background_status", """
    WITH v AS (SELECT source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)), d AS (SELECT source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), n AS (SELECT source FROM documents WHERE n_chars > 5000),
    a AS (SELECT source, 'v' AS l FROM v UNION ALL SELECT source, 'd' FROM d UNION ALL SELECT source, 'n' FROM n)
    SELECT source, count(*) FILTER (WHERE l = 'v') AS vectors, count(*) FILTER (WHERE l = 'd') AS dream, count(*) FILTER (WHERE l = 'n') AS perception, count(*) = 0 AS quiet FROM a GROUP BY source""")
def background_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    have = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("doc_id"))
    return r.pending_status({"vectors": d.join(have("embeddings", "vec_id"), "doc_id", "left_anti"), "dream": d.join(have("labels", "doc_id"), "doc_id", "left_anti"), "perception": d.where("n_chars > 5000")}, "source")


@query("specific_mentions", """
    WITH m AS (SELECT o_orderkey AS id, o_custkey AS memory, o_orderkey * 13 % 50 AS start, o_orderkey * 13 % 50 + o_orderkey * 7 % 30 + 1 AS "end" FROM orders)
    SELECT id, memory, start, "end" FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.memory = a.memory AND b.id <> a.id AND b.start <= a.start AND b."end" >= a."end"
        AND (b.start < a.start OR b."end" > a."end" OR b.id < a.id))""")
def specific_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    m = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("memory"), (k * 13 % 50).alias("start"), (k * 13 % 50 + k * 7 % 30 + 1).alias("end"))
    return r.most_specific(m, ["memory"])


@query("resolution_retry", """
    SELECT c_custkey, c_custkey % 3 = 0 AND (c_custkey % 7 = 0 OR c_nationkey % 5 = 0) AS retry FROM customer""")
def resolution_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(i, "c_nationkey", F.when(i % 3 == 0, "pending").otherwise("resolved").alias("status"), i.alias("candidates"), F.col("c_nationkey").alias("context"))
    now = c.select("c_custkey", F.when(i % 7 == 0, -1).otherwise(F.col("candidates")).alias("candidates"), F.when(F.col("c_nationkey") % 5 == 0, None).otherwise(F.col("context")).alias("context"))
    return r.retry_needed(c, now, "c_custkey")


@query("record_ids", """
    SELECT c_custkey, sha256('entity/' || strlen(c_name) || ':' || c_name || strlen(CAST(c_nationkey AS VARCHAR)) || ':' || c_nationkey) AS id FROM customer""")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", r.identifier("entity", F.col("c_name"), F.col("c_nationkey")).alias("id"))


@query("anchor_documents", """
    WITH u AS (SELECT doc_id, lang, n_chars, sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id, text ROWS UNBOUNDED PRECEDING) AS used FROM documents)
    SELECT doc_id, lang, CAST(used AS BIGINT) AS used FROM u WHERE used <= 25000""")
def anchor_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by number while 25,000 characters of a language last."""
    return r.bounded_documents(table(spark, sf_dir, "documents"), "lang", "doc_id", "text", 25_000).select("doc_id", "lang", "used")


@query("truncated_names", """
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN substr(text, 1, CAST(list_max(list_filter(range(0, 102), lambda k: octet_length(encode(substr(text, 1, k))) <= 101)) AS INTEGER)) END AS head FROM documents""")
def truncated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", r.truncated(F.col("text"), 101).alias("head"))


@query("simulated_embedding")
def simulated_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for the turns, as a model would give them."""
    return r.embedded(turns(spark, sf_dir), "id", "content", 32)


@query("name_inheritance", f"""WITH {_GENERATIONS_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY old ORDER BY jaccard DESC) AS ro, rank() OVER (PARTITION BY new ORDER BY jaccard DESC) AS rn FROM j),
    c AS (SELECT old, new, jaccard FROM r WHERE ro = 1 AND rn = 1 QUALIFY count(*) OVER (PARTITION BY old) = 1 AND count(*) OVER (PARTITION BY new) = 1)
    SELECT new AS community, 'name ' || old AS name FROM c WHERE old % 2 = 0 OR jaccard >= 750""")
def name_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the first generation's communities (even ones by a user) that the second keeps."""
    before, after = _generations(spark, sf_dir)
    links = communities.lineage(before, after).where("continuation")
    old = before.select("community").distinct()
    names = old.select("community", F.concat(F.lit("name "), "community").alias("name"), F.when(F.col("community") % 2 == 0, "user").otherwise("model").alias("source"))
    return r.inherited_names(links, names)


@query("store_stats", """
    SELECT 'memories' AS store, count(*) AS rows, count(DISTINCT text) AS distinct_rows, count(*) FILTER (WHERE lang = 'en') AS flagged FROM documents
    UNION ALL SELECT 'graph', count(*), count(DISTINCT (l_partkey, l_suppkey)), count(*) FILTER (WHERE l_returnflag <> 'R') FROM lineitem
    UNION ALL SELECT 'communities', count(*), count(DISTINCT label), count(*) FILTER (WHERE label = 0) FROM embeddings
    UNION ALL SELECT 'vectors', count(*), count(DISTINCT embedding), count(*) FILTER (WHERE embedding IS NOT NULL) FROM embeddings
    UNION ALL SELECT 'work', count(*), count(DISTINCT user_id), count(*) FILTER (WHERE event_type = 'error') FROM events""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of five stores: rows, distinct ones, and those with a flag."""
    get = lambda n: table(spark, sf_dir, n)
    return r.statistics({
        "memories": (get("documents"), ["text"], F.col("lang") == "en"), "graph": (get("lineitem"), ["l_partkey", "l_suppkey"], F.col("l_returnflag") != "R"),
        "communities": (get("embeddings"), ["label"], F.col("label") == 0), "vectors": (get("embeddings"), ["embedding"], F.col("embedding").isNotNull()), "work": (get("events"), ["user_id"], F.col("event_type") == "error"),
    })


@query("json_payloads", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 = 0 END AS BOOLEAN) AS present, CASE WHEN event_id % 5 = 0 THEN 'invalid' ELSE 'ok' END AS state FROM events""")
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's structured answers parsed by a schema; some aren't JSON."""
    i = F.col("event_id")
    answer = F.when(i % 5 == 0, "no json").otherwise(F.to_json(F.struct((i % 3 == 0).alias("present"), F.get_json_object("props", "$.k").cast("long").alias("k"))))
    ev = table(spark, sf_dir, "events").select(i, "props", answer.alias("answer"))
    parsed = r.parsed(ev, "answer", "present boolean, k long")
    return parsed.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "present", "state")


@query("ego_documents", """
    WITH l AS (SELECT user_id AS id, event_id AS version, event_type = 'error' AS deleted, CAST(event_id % 3 AS INTEGER) AS priority, event_type || ' ' || event_id AS text FROM events),
    n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1), u AS (SELECT id, priority, text, sum(length(text)) OVER (ORDER BY priority, id) AS used FROM n WHERE NOT deleted)
    SELECT id, priority, text, CAST(used AS BIGINT) AS used FROM u WHERE used <= 1000""")
def ego_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last revisions as anchors, without deleted ones, by priority while 1,000 characters last."""
    ev, i = table(spark, sf_dir, "events"), F.col("event_id")
    log = ev.select(F.col("user_id").alias("id"), i.alias("version"), (F.col("event_type") == "error").alias("deleted"), (i % 3).cast("int").alias("priority"), F.concat_ws(" ", "event_type", "event_id").alias("text"))
    return r.current_documents(log, 1000)
