"""Queries over two replicas: each user's events, with the right one changed, cut or extended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import reconcile as r
from ..operators.order import numbered


def _replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Left lacks the last 5 events of users divisible by 3; right has a changed 4th event for users
    divisible by 4, and lacks the last 3 of users divisible by 5."""
    ev = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id")
    e = ev.select("user_id", "event_id", "event_type", (F.row_number().over(w.orderBy("event_id")) - 1).cast("long").alias("position"), F.count("*").over(w).alias("n"))
    left = e.where((F.col("user_id") % 3 != 0) | (F.col("position") < F.col("n") - 5))
    changed = F.when((F.col("user_id") % 4 == 0) & (F.col("position") == 3), F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type"))
    right = e.where((F.col("user_id") % 5 != 0) | (F.col("position") < F.col("n") - 3)).withColumn("event_type", changed)
    digest = F.concat_ws(":", "event_id", "event_type")
    return left.withColumn("digest", digest), right.withColumn("digest", digest)


_SQL = """e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    l AS (SELECT *, event_id || ':' || event_type AS digest FROM e WHERE user_id % 3 <> 0 OR position < n - 5),
    r0 AS (SELECT user_id, event_id, position, n, CASE WHEN user_id % 4 = 0 AND position = 3 THEN event_type || '!' ELSE event_type END AS event_type FROM e WHERE user_id % 5 <> 0 OR position < n - 3),
    r AS (SELECT *, event_id || ':' || event_type AS digest FROM r0),
    b AS (SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.position, r.position) AS position, l.digest AS ld, r.digest AS rd FROM l FULL JOIN r ON l.user_id = r.user_id AND l.position = r.position),
    s AS (SELECT user_id, min(position) FILTER (WHERE ld IS DISTINCT FROM rd) AS f, count(ld) AS left_length, count(rd) AS right_length, max(position) AS e FROM b GROUP BY 1),
    v AS (SELECT user_id, coalesce(f, e + 1) AS prefix, left_length, right_length, CASE WHEN f IS NULL THEN 'identical' WHEN f >= right_length THEN 'left extends'
          WHEN f >= left_length THEN 'right extends' ELSE 'diverged' END AS verdict FROM s)"""


@query("replica_compare", f"WITH {_SQL} SELECT user_id, verdict, prefix, left_length, right_length FROM v")
def replica_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.compared(*_replicas(spark, sf_dir), ["user_id"], "position", "digest")


@query("replica_tail", f"WITH {_SQL} SELECT r.user_id, r.event_id, r.position FROM r JOIN v USING (user_id) WHERE r.position >= v.prefix")
def replica_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _replicas(spark, sf_dir)
    v = r.compared(left, right, ["user_id"], "position", "digest")
    return r.tail(right, v, ["user_id"], "position").select("user_id", "event_id", "position")


@query("replay_tail", f"""WITH {_SQL}, t AS (SELECT r.* FROM r JOIN v USING (user_id) WHERE r.position >= v.prefix),
    f AS (SELECT t.*, row_number() OVER (PARTITION BY user_id ORDER BY position) - 1 AS k FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = t.user_id AND l.digest = t.digest)),
    m AS (SELECT user_id, max(position) + 1 AS e FROM l GROUP BY 1)
    SELECT f.user_id, f.event_id, coalesce(m.e, 0) + k AS position FROM f LEFT JOIN m USING (user_id)""")
def replay_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the right tail is appended to the left log, and where."""
    left, right = _replicas(spark, sf_dir)
    t = r.tail(right, r.compared(left, right, ["user_id"], "position", "digest"), ["user_id"], "position")
    return r.replayed(left, t, ["user_id"], "position", "digest").select("user_id", "event_id", "position")


@query("graph_tail_conflicts", f"""WITH {_SQL}, a AS (SELECT user_id, event_id % 3 AS edge, list(event_type ORDER BY position) AS ls FROM l GROUP BY 1, 2),
    c AS (SELECT user_id, event_id % 3 AS edge, list(event_type ORDER BY position) AS rs FROM r GROUP BY 1, 2)
    SELECT user_id, edge, len(ls) AS left_n, len(rs) AS right_n FROM a JOIN c USING (user_id, edge) WHERE ls[1:least(len(ls), len(rs))] <> rs[1:least(len(ls), len(rs))]""")
def graph_tail_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys (user, event modulo 3) whose sequences of types contradict each other."""
    left, right = (df.withColumn("edge", F.col("event_id") % 3) for df in _replicas(spark, sf_dir))
    found = r.incompatible_states(left, right, ["user_id", "edge"], "position", "event_type")
    return found.select("user_id", "edge", F.size("left_states").cast("long").alias("left_n"), F.size("right_states").cast("long").alias("right_n"))


@query("typed_conflicts", f"""WITH {_SQL} SELECT 'only left' AS kind, event_id, '' AS field FROM l WHERE event_id NOT IN (SELECT event_id FROM r)
    UNION ALL SELECT 'only right', event_id, '' FROM r WHERE event_id NOT IN (SELECT event_id FROM l)
    UNION ALL SELECT 'differs', l.event_id, 'event_type' FROM l JOIN r USING (event_id) WHERE l.event_type <> r.event_type""")
def typed_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _replicas(spark, sf_dir)
    return r.conflicts(left, right, ["event_id"], ["event_type", "position"]).where("field <> 'position'")


def _stores(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Two stores of the same records, the right one with some of them changed."""
    get = lambda n: table(spark, sf_dir, n)
    records = {
        "source_turn": get("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("text").alias("content"), F.col("turn").cast("long").alias("n")),
        "branch": get("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("content"), F.col("s_suppkey").alias("n")),
        "episode": get("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("content"), F.col("c_custkey").alias("n")),
        "fragment": get("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("content"), F.col("p_partkey").alias("n")),
        "file": get("pages").select(F.col("page_id").alias("key"), F.col("url").alias("content"), F.col("page_id").alias("n")),
        "insomnia_completion": get("labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("string").alias("content"), F.col("doc_id").alias("n")),
    }
    left = {k: df.drop("n") for k, df in records.items()}
    right = {k: df.withColumn("content", F.when(F.col("n") % 7 == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).drop("n") for k, df in records.items()}
    o = get("orders")
    revision = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    m = o.select(F.col("o_custkey").alias("id"), revision.alias("revision"), F.col("o_orderkey").alias("mutation"), (F.col("o_custkey") % 5).alias("body"))
    left["memory"] = m.where("revision <= 4")
    changed = m.where("revision between 3 and 6")
    right["memory"] = changed.select("id", F.when(F.col("id") % 6 == 2, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), "mutation", F.when((F.col("id") % 11 == 4) & (F.col("revision") > 4), -1).otherwise(F.col("body")).alias("body"))
    a, b = _replicas(spark, sf_dir)
    for kind, k in (("graph_relation", 3), ("semantic_graph_relation", 2)):
        left[kind], right[kind] = (df.select((F.col("user_id") * 10 + F.col("event_id") % k).alias("key"), F.col("position").alias("version"), F.col("event_type").alias("state")) for df in (a, b))
    return left, right


_MEMORY_SQL = """m AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, o_orderkey AS mutation, o_custkey % 5 AS body FROM orders),
    ml AS (SELECT * FROM m WHERE revision <= 4), mr AS (SELECT id, CASE WHEN id % 6 = 2 THEN revision + 1 ELSE revision END AS revision, mutation, CASE WHEN id % 11 = 4 AND revision > 4 THEN -1 ELSE body END AS body FROM m WHERE revision BETWEEN 3 AND 6),
    fr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision) AS n FROM mr WHERE mutation NOT IN (SELECT mutation FROM ml)), nw AS (SELECT id, max(revision) AS r, max_by(body, revision) AS body FROM ml GROUP BY id)"""


def _graph_sql(k: int) -> str:
    return f"""SELECT user_id * 10 + edge FROM (SELECT user_id, event_id % {k} AS edge, list(event_type ORDER BY position) AS ls FROM l GROUP BY 1, 2) JOIN (SELECT user_id, event_id % {k} AS edge, list(event_type ORDER BY position) AS rs FROM r GROUP BY 1, 2) USING (user_id, edge)
        WHERE ls[1:least(len(ls), len(rs))] <> rs[1:least(len(ls), len(rs))]"""


@query("conflict_kinds", f"""WITH {_SQL}, {_MEMORY_SQL}, c(kind, key) AS (
    SELECT 'source_turn', conv_id || ':' || turn FROM conversations WHERE turn % 7 = 3 UNION SELECT 'branch', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 7 = 3
    UNION SELECT 'episode', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 7 = 3 UNION SELECT 'fragment', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 7 = 3
    UNION SELECT 'file', CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 7 = 3 UNION SELECT 'insomnia_completion', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id % 7 = 3
    UNION SELECT 'memory_mutation', CAST(mr.id AS VARCHAR) FROM ml JOIN mr USING (mutation) WHERE ml.revision <> mr.revision OR ml.body <> mr.body
    UNION SELECT 'memory_semantic_mutation', CAST(fr.id AS VARCHAR) FROM fr JOIN nw USING (id) WHERE nw.body <> fr.body
    UNION SELECT 'memory_revision', CAST(fr.id AS VARCHAR) FROM fr LEFT JOIN nw USING (id) WHERE fr.revision <> coalesce(nw.r, 0) + n
    UNION SELECT 'graph_relation', CAST(k AS VARCHAR) FROM ({_graph_sql(3)}) t(k) UNION SELECT 'semantic_graph_relation', CAST(k AS VARCHAR) FROM ({_graph_sql(2)}) t(k))
    SELECT kind, key FROM c""")
def conflict_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven kinds of conflicts between two stores."""
    return r.all_conflicts(*_stores(spark, sf_dir))


@query("memory_replay", f"""WITH {_MEMORY_SQL}, k AS (SELECT mr.*, mutation IN (SELECT mutation FROM ml) AS known FROM mr),
    f AS (SELECT *, sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY revision) AS fresh FROM k)
    SELECT f.id, f.revision, CASE WHEN known THEN 'duplicate' WHEN f.revision = coalesce(nw.r, 0) + fresh THEN 'replayed' ELSE 'conflict' END AS outcome FROM f LEFT JOIN nw USING (id)""")
def memory_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right store's revisions put onto the left one's."""
    left, right = _stores(spark, sf_dir)
    return r.replayed_revisions(left["memory"], right["memory"]).select("id", "revision", "outcome")


@query("entity_replay", f"""WITH {_MEMORY_SQL}, k AS (SELECT mr.*, mutation IN (SELECT mutation FROM ml) AS known FROM mr),
    f AS (SELECT *, sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY revision) AS fresh FROM k)
    SELECT f.id, f.revision, CASE WHEN known THEN 'duplicate' WHEN f.id % 13 = 5 THEN 'retired' WHEN f.revision = coalesce(nw.r, 0) + fresh THEN 'replayed' ELSE 'conflict' END AS outcome FROM f LEFT JOIN nw USING (id)
    UNION ALL SELECT c_custkey, NULL, 'tombstone' FROM customer WHERE c_custkey % 26 = 18""")
def entity_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for entities, of which the left store has retired some, and the right one others as well."""
    left, right = _stores(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    dead = c.where("id % 13 = 5 and id % 26 <> 18")
    rows, fresh = r.replayed_entities(left["memory"], dead, right["memory"], c.where("id % 13 = 5").withColumn("replacement_id", F.lit(0)))
    return rows.select("id", "revision", "outcome").union(fresh.select("id", F.lit(None).cast("int"), F.lit("tombstone")))


@query("graph_replay", """
    WITH g AS (SELECT o_orderkey AS version, o_custkey AS source, o_orderkey % 3 AS target, o_orderstatus <> 'F' AS active FROM orders), h AS (SELECT max(version) // 2 AS half FROM g),
    l AS (SELECT g.* FROM g, h WHERE version <= half), t AS (SELECT g.* FROM g, h WHERE version > half), w AS (SELECT source, target, max_by(active, version) AS now FROM l GROUP BY 1, 2),
    b AS (SELECT t.*, coalesce(lag(t.active) OVER (PARTITION BY t.source, t.target ORDER BY t.version), w.now, false) AS was FROM t LEFT JOIN w USING (source, target))
    SELECT source, target, active, (SELECT max(version) FROM l) + row_number() OVER (ORDER BY version, source, target) AS version FROM b WHERE active <> was""")
def graph_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the orders as mutations put onto the earlier half: what changes an edge, renumbered."""
    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 3).alias("target"), (F.col("o_orderstatus") != "F").alias("active"))
    both = g.crossJoin(g.agg(F.expr("max(version) div 2").alias("half")))  # one row
    return r.replayed_graph(both.where("version <= half").drop("half"), both.where("version > half").drop("half"), ["source", "target"])


#: Events as the log of a store: views are turns, purchases revisions of statements, signups those of
#: entities (every fifth a tombstone), clicks mutations of edges, errors links of files.
_TABLE_OF = "CASE event_type WHEN 'view' THEN 'turns' WHEN 'purchase' THEN 'memories' WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'tombstones' ELSE 'entities' END WHEN 'click' THEN 'relations' ELSE 'links' END"


def _divided(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Two stores that agree on the first half of the events; then the left one has the events divisible
    by three, the right one the others and, up to three quarters, those of the left one as well."""
    ev = table(spark, sf_dir, "events")
    n = ev.agg(F.max("event_id").alias("n"))  # one row
    e = ev.crossJoin(n).withColumn("part", F.expr(_TABLE_OF)).withColumn("own", F.expr("user_id * 3 + event_id % 3"))
    kept = {"left": "2 * event_id < n OR event_id % 3 = 0", "right": "2 * event_id < n OR event_id % 3 <> 0 OR 4 * event_id < 3 * n"}
    out = []
    for where in kept.values():
        rows = numbered(e.where(where), ["event_id"])
        t = lambda name, rows=rows: rows.where(F.col("part") == name)
        revision = F.row_number().over(Window.partitionBy("own").orderBy("event_id"))
        revised = lambda name, t=t: t(name).select("position", F.col("own").alias("id"), revision.alias("revision"), F.col("event_id").alias("mutation"), (F.col("own") % 7).alias("body"))  # noqa: E731, B023
        out.append({
            "turns": t("turns").select("position", F.col("event_id").alias("id"), F.col("event_type").alias("content")),
            "memories": revised("memories"),
            "entities": revised("entities"),
            "tombstones": t("tombstones").select("position", F.col("own").alias("id"), F.lit(0).alias("replacement_id")),
            "relations": t("relations").select("position", F.col("own").alias("source"), (F.col("event_id") % 5).alias("target"), F.lit(1).alias("kind"), (F.col("event_id") % 2 == 0).alias("active")),
            "links": t("links").select("position", (F.col("event_id") % 7).alias("file_id"), F.col("own").alias("memory_id")),
        })
    return out[0], out[1]


_DIVIDED_SQL = f"""x AS (SELECT max(event_id) AS n FROM events), e AS (SELECT *, {_TABLE_OF} AS part, user_id * 3 + event_id % 3 AS own, event_id % 5 AS target FROM events, x),
    l AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS position FROM e WHERE 2 * event_id < n OR event_id % 3 = 0),
    r AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS position FROM e WHERE 2 * event_id < n OR event_id % 3 <> 0 OR 4 * event_id < 3 * n),
    c AS (SELECT min(coalesce(l.position, r.position)) AS common FROM l FULL JOIN r ON l.position = r.position WHERE l.event_id IS DISTINCT FROM r.event_id),
    t AS (SELECT r.* FROM r, c WHERE r.position >= common), lt AS (SELECT l.* FROM l, c WHERE l.position >= common),
    dead AS (SELECT own FROM l WHERE part = 'tombstones' UNION SELECT own FROM t WHERE part = 'tombstones'),
    j AS (SELECT t.*, CASE part
        WHEN 'turns' THEN CASE WHEN event_id IN (SELECT event_id FROM l) THEN 'duplicate' ELSE 'replayed' END
        WHEN 'memories' THEN CASE WHEN event_id IN (SELECT event_id FROM l) THEN 'duplicate' ELSE 'replayed' END
        WHEN 'entities' THEN CASE WHEN event_id IN (SELECT event_id FROM l) THEN 'duplicate' WHEN own IN (SELECT own FROM dead) THEN 'retired' ELSE 'replayed' END
        WHEN 'tombstones' THEN CASE WHEN own IN (SELECT own FROM l WHERE part = 'tombstones') OR row_number() OVER (PARTITION BY part, own ORDER BY position) > 1 THEN 'duplicate' ELSE 'replayed' END
        WHEN 'relations' THEN CASE WHEN row_number() OVER (PARTITION BY part, own, target ORDER BY position) <= (SELECT count(*) FROM lt WHERE lt.part = 'relations' AND lt.own = t.own AND lt.target = t.target) THEN 'duplicate' ELSE 'replayed' END
        ELSE CASE WHEN (own, event_id % 7) IN (SELECT (own, event_id % 7) FROM l WHERE part = 'links') OR row_number() OVER (PARTITION BY part, own, event_id % 7 ORDER BY position) > 1 THEN 'duplicate' ELSE 'replayed' END END AS outcome FROM t),
    o AS (SELECT *, list_position(['turns', 'memories', 'entities', 'tombstones', 'relations', 'links'], part) AS rank FROM j),
    s AS (SELECT part, position, own, event_id FROM l UNION ALL SELECT part, (SELECT count(*) FROM l) + row_number() OVER (ORDER BY rank, position) - 1, own, event_id FROM o WHERE outcome = 'replayed')"""
#: What names a record of each table.
_NAMES = {"turns": "id", "memories": "mutation", "entities": "mutation", "tombstones": "id", "relations": "source", "links": "memory_id"}


@query("reconciled_store", f"WITH {_DIVIDED_SQL} SELECT part, position, CASE WHEN part IN ('turns', 'memories', 'entities') THEN event_id ELSE own END AS name FROM s")
def reconciled_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the store that two diverged ones make, where they are in its log."""
    store, _, _ = r.reconciled_stores(*_divided(spark, sf_dir), size=64)
    out = None
    for part, name in _NAMES.items():
        rows = store[part].select(F.lit(part).alias("part"), "position", F.col(name).cast("long").alias("name"))
        out = rows if out is None else out.union(rows)
    return out


@query("reconcile_report", f"""WITH {_DIVIDED_SQL} SELECT outcome || ' ' || part AS item, CAST(count(*) AS VARCHAR) AS value FROM o GROUP BY ALL
    UNION ALL SELECT unnest(['relation', 'common', 'left_length', 'right_length', 'change_required']), unnest(['diverged', CAST(common AS VARCHAR), CAST((SELECT count(*) FROM l) AS VARCHAR), CAST((SELECT count(*) FROM r) AS VARCHAR), 'true']) FROM c""")
def reconcile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reconciliation counts."""
    _, report, _ = r.reconciled_stores(*_divided(spark, sf_dir), size=64)
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return spark.createDataFrame([(k, text(v)) for k, v in report.items()], "item string, value string")
