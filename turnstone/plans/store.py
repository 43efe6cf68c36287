"""Queries over stores: listing, opening, revisions, links, snapshots, promotion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import archive as a
from ..operators import store as s
from ..session import scratch
from .tables import MINUTE, TREE_SQL, TURNS_SQL, tree, turns


@query("chunk_listing", """
    SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS key FROM orders UNION ALL SELECT 'conversations', conv_id || ':' || turn FROM conversations
    UNION ALL SELECT 'labels', CAST(doc_id AS VARCHAR) FROM labels""")
def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of three logs by their keys."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "conversations", "labels")}
    return s.chunks(t, {"orders": ["o_orderkey"], "conversations": ["conv_id", "turn"], "labels": ["doc_id"]}).select("table", "key")


_REFERENCES = [("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("embeddings", "vec_id", "documents", "doc_id")]
_KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "documents": ["doc_id"], "labels": ["doc_id"], "embeddings": ["vec_id"], "events": ["user_id", "event_type"]}


def _opened_sql(names: list[str]) -> str:
    rows = []
    for n in names:
        key = ", ".join(_KEYS[n])
        none = " OR ".join(f"{k} IS NULL" for k in _KEYS[n])
        lost = " + ".join(f"(SELECT count(*) FROM {n} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {to} FROM {t}))" for m, c, t, to in _REFERENCES if m == n and t in names) or "0"
        rows.append(f"""SELECT '{n}' AS "table", count(*) AS rows, (SELECT count(*) FROM (SELECT 1 FROM {n} GROUP BY {key} HAVING count(*) > 1)) AS repeated_keys,
            count(*) FILTER (WHERE {none}) AS null_keys, {lost} AS dangling FROM {n}""")
    return " UNION ALL ".join(rows)


def _opened(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return s.opened({n: table(spark, sf_dir, n) for n in names}, _KEYS, [r for r in _REFERENCES if r[0] in names and r[2] in names])


@query("open_store", _opened_sql(list(_KEYS)))
def open_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opening all logs finds: repeated and missing keys, references to nothing."""
    return _opened(spark, sf_dir, list(_KEYS))


@query("open_owner_store", _opened_sql(["documents", "labels", "embeddings"]))
def open_owner_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's store: statements, their flags and vectors, no conversations."""
    return _opened(spark, sf_dir, ["documents", "labels", "embeddings"])


@query("branch_revisions", f"""WITH RECURSIVE {TREE_SQL}, l AS (SELECT conversation_id, id, turn FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = t.id)),
    up(leaf, id) AS (SELECT id, id FROM l UNION ALL SELECT u.leaf, t.parent_id FROM up u JOIN tree t ON t.id = u.id WHERE t.parent_id IS NOT NULL),
    cur AS (SELECT conversation_id AS branch, conversation_id || ':2' AS leaf FROM tree WHERE turn = 2 AND conversation_id % 4 <> 0)
    SELECT l.conversation_id AS branch, l.id AS leaf, CASE WHEN c.leaf IS NULL THEN 'new' WHEN c.leaf = l.id THEN 'same'
           WHEN EXISTS (SELECT 1 FROM up WHERE up.leaf = l.id AND up.id = c.leaf) THEN 'extends' ELSE 'rejected' END AS outcome
    FROM l LEFT JOIN cur c ON c.branch = l.conversation_id""")
def branch_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf offered as the end of its conversation's branch, which ends at turn 2 (or isn't there)."""
    nodes = tree(spark, sf_dir)
    ends = a.leaves(nodes).select("conversation_id", F.col("id").alias("leaf"))
    paths = a.paths(nodes, ends).select("leaf", "id")
    current = nodes.where("turn = 2 and conversation_id % 4 <> 0").select(F.col("conversation_id").alias("branch"), F.col("id").alias("leaf"))
    return s.branch_revisions(current, ends.select(F.col("conversation_id").alias("branch"), "leaf"), paths)


@query("status_updates", """
    WITH now AS (SELECT doc_id AS id, quality + 1 AS revision, CASE WHEN toxic = 1 THEN 'historical' ELSE 'current' END AS status FROM labels),
    u AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'future' WHEN 2 THEN 'past' END AS status FROM documents)
    SELECT u.id, u.status, o.outcome, CASE WHEN o.outcome = 'written' THEN n.revision + 1 END AS revision FROM u LEFT JOIN now n USING (id),
    LATERAL (SELECT CASE WHEN n.revision IS NULL THEN 'unknown' WHEN u.status IS NULL OR u.status NOT IN ('current', 'future', 'historical') THEN 'invalid'
             WHEN n.status IS NOT DISTINCT FROM u.status THEN 'equal' ELSE 'written' END AS outcome) o""")
def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, d, k = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    now = l.select(F.col("doc_id").alias("id"), (F.col("quality") + 1).alias("revision"), F.when(F.col("toxic") == 1, "historical").otherwise("current").alias("status"))
    return s.status_updates(now, d.select(F.col("doc_id").alias("id"), F.when(k == 0, "current").when(k == 1, "future").when(k == 2, "past").alias("status")))


@query("conversation_titles", """
    WITH m AS (SELECT user_id AS c, event_id AS v, event_type AS title, event_type <> 'error' AS active FROM events), l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY c ORDER BY v DESC) = 1)
    SELECT x.conversation_id, l.title, coalesce(l.active, true) AS active FROM (SELECT DISTINCT conv_id AS conversation_id FROM conversations) x LEFT JOIN l ON l.c = x.conversation_id""")
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("version"), F.col("event_type").alias("title"), (F.col("event_type") != "error").alias("active"))
    return s.titled(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id")).distinct(), log)


@query("file_links", f"""
    WITH {TURNS_SQL}, f AS (SELECT page_id AS file_id, url AS filename FROM pages), n AS (SELECT count(*) AS n FROM pages),
    src AS (SELECT id AS owner, unnest([0, 1]) AS place, unnest([timestamp_ns // {MINUTE} % n, (timestamp_ns // {MINUTE} + 7) % n]) AS file_id FROM turns, n WHERE role = 'user'),
    mem AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS owner, unnest([doc_id % n, doc_id * 3 % n]) AS file_id FROM documents, n)
    SELECT 'source' AS owner_kind, owner, place, file_id, filename FROM src JOIN f USING (file_id)
    UNION ALL SELECT 'memory', owner, row_number() OVER (PARTITION BY owner ORDER BY file_id) - 1, file_id, filename FROM mem JOIN f USING (file_id)""")
def file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages attached to user turns, two each, and those that documents name."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("filename"))
    n = p.agg(F.count("*").alias("n"))  # one row
    minute = F.expr(f"timestamp_ns div {MINUTE}")
    src = turns(spark, sf_dir).where("role = 'user'").crossJoin(n).select(F.col("id").alias("owner"), F.array(minute % F.col("n"), (minute + 7) % F.col("n")).alias("file_ids"))
    mem = table(spark, sf_dir, "documents").crossJoin(n).select(F.col("doc_id").cast("string").alias("owner"), F.explode(F.array(F.col("doc_id") % F.col("n"), F.col("doc_id") * 3 % F.col("n"))).alias("file_id"))
    return s.linked_files(p, src, mem)


@query("knowledge_snapshot", """
    WITH p AS (SELECT 'memories' AS part, CAST(doc_id AS VARCHAR) AS key, '{"lang":"' || lang || '","source":"' || source || '"}' AS body FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL
        UNION ALL SELECT 'entities', CAST(p_partkey AS VARCHAR), '{"name":"' || p_name || '"}' FROM part UNION ALL SELECT 'relations', CAST(l_partkey AS VARCHAR), '{"supplier":' || l_suppkey || '}' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
        UNION ALL SELECT 'communities', CAST(label AS VARCHAR), '{"members":' || count(*) || '}' FROM embeddings GROUP BY label UNION ALL SELECT 'names', CAST(n_nationkey AS VARCHAR), '{"name":"' || n_name || '"}' FROM nation)
    SELECT part, count(*) AS rows, min(key) AS first_key, max(body) AS last_body FROM p GROUP BY part""")
def knowledge_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, entities, relations, communities and names of an owner, summed up by part."""
    get = lambda n: table(spark, sf_dir, n)
    parts = {
        "memories": get("documents").where("lang is not null and source is not null").select(F.col("doc_id").alias("key"), "lang", "source"),
        "entities": get("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")),
        "relations": get("lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("supplier")).distinct(),
        "communities": get("embeddings").groupBy(F.col("label").alias("key")).agg(F.count("*").alias("members")),
        "names": get("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")),
    }
    return s.snapshot(parts).groupBy("part").agg(F.count("*").alias("rows"), F.min("key").alias("first_key"), F.max("body").alias("last_body"))


@query("episode_bounds", f"""
    WITH {TURNS_SQL}, e AS (SELECT conversation_id, turn // 3 AS episode, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns FROM turns GROUP BY 1, 2),
    n AS (SELECT *, lead(first_ns) OVER (PARTITION BY conversation_id ORDER BY episode) AS nx FROM e)
    SELECT conversation_id, episode, CASE WHEN nx IS NULL THEN 'inactivity' ELSE 'size' END AS boundary, greatest(coalesce(nx, {1000 * MINUTE}), last_ns) AS finalized_ns FROM n""")
def episode_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of three turns: how and when each ends, the clock standing at minute 1,000."""
    e = turns(spark, sf_dir).groupBy("conversation_id", F.expr("turn div 3").alias("episode")).agg(F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
    return s.episode_bounds(e, "conversation_id", "inactivity", 1000 * MINUTE).select("conversation_id", "episode", "boundary", "finalized_ns")


@query("promote", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even nations put in the place of all, once the copy is whole."""
    path = f"{scratch(spark)}/store-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s.promoted(n, path)
    return s.promoted(n.where("n_nationkey % 2 = 0"), path)
