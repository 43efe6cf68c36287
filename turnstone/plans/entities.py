"""Queries over entities: nations, suppliers and customers, parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import entities as e

_LOOSE = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as entities; their aliases: number, a repository, capitals."""
    n = table(spark, sf_dir, "nation")
    aliases = F.array(F.concat(F.lit("nation "), F.col("n_nationkey")), F.concat("n_name", F.lit(" repo")), F.upper(F.substring("n_name", 1, 3)))
    return n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), aliases.alias("aliases"), F.col("n_regionkey").alias("kind"))


_SURFACES_SQL = f"""s AS (SELECT n_nationkey AS id, unnest([n_name, 'nation ' || n_nationkey, n_name || ' repo', upper(n_name[1:3])]) AS name FROM nation),
    al AS (SELECT id, unnest([CASE WHEN r <> '' THEN 'repository:' || lower(r) END, CASE WHEN w <> '' THEN 'acronym:' || lower(w) END, CASE WHEN p <> '' THEN 'acronym:' || lower(p) END]) AS key
           FROM (SELECT id, regexp_extract(name, '(?i)^\\s*(\\S+)\\s+repo(?:sitory)?\\s*$', 1) AS r, regexp_extract(name, '^\\s*([A-Z]{{2,}})s?\\s*$', 1) AS w,
                        regexp_extract(name, '^\\s*([A-Z]{{2,4}})\\s+\\S', 1) AS p FROM s)),
    idx AS (SELECT DISTINCT lower(trim(name)) AS key, id, 'exact' AS lane FROM s UNION SELECT DISTINCT {_LOOSE.format("name")}, id, 'normalized' FROM s
            UNION SELECT key, id, 'alias' FROM al WHERE key IS NOT NULL)"""


@query("alias_keys", f"WITH {_SURFACES_SQL} SELECT key, id, lane FROM idx WHERE key <> ''")
def alias_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys under which a nation is found."""
    return e.surfaces(_nations(spark, sf_dir)).withColumn("id", F.col("id").cast("int"))


_MENTIONS_SQL = """m AS (SELECT s_suppkey AS mention, CASE s_suppkey % 3 WHEN 0 THEN ' ' || lower(n_name) WHEN 1 THEN 'Nation-' || s_nationkey ELSE upper(n_name[1:3]) END AS surface
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_LOOKUP_SQL = f"""{_SURFACES_SQL}, {_MENTIONS_SQL}, hit AS (
    SELECT DISTINCT mention, id, lane FROM m JOIN idx ON lane = 'exact' AND key = lower(trim(surface))
    UNION SELECT DISTINCT mention, id, lane FROM m JOIN idx ON lane = 'normalized' AND key <> '' AND key = {_LOOSE.format("surface")}
    UNION SELECT DISTINCT mention, id, lane FROM m JOIN idx ON lane = 'alias' AND key = 'acronym:' || lower(surface) AND regexp_full_match(surface, '[A-Z]{{2,}}'))"""


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey") % 3
    surface = F.when(k == 0, F.concat(F.lit(" "), F.lower("n_name"))).when(k == 1, F.concat(F.lit("Nation-"), "s_nationkey")).otherwise(F.upper(F.substring("n_name", 1, 3)))
    mentions = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("mention"), surface.alias("surface"))
    return e.looked_up(mentions, e.surfaces(_nations(spark, sf_dir)))


@query("surface_lookup", f"WITH {_LOOKUP_SQL} SELECT mention, id, lane FROM hit")
def surface_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir)


@query("entity_candidates", f"""WITH {_LOOKUP_SQL}, l AS (SELECT mention, id, lane, NULL AS support, NULL AS score FROM hit UNION ALL
        SELECT s_suppkey, n_nationkey, 'association', NULL, NULL FROM supplier JOIN nation ON n_regionkey = s_suppkey % 5
        UNION ALL SELECT l_suppkey, c_nationkey, 'lexical', o_orderkey, l_discount FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 48
        UNION ALL SELECT l_suppkey, c_nationkey, 'graph', c_custkey, NULL FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity < 3),
    f AS (SELECT mention, id, max(CAST(lane = 'exact' AS INT)) AS exact, max(CAST(lane = 'normalized' AS INT)) AS normalized, max(CAST(lane = 'alias' AS INT)) AS alias,
                 max(CAST(lane = 'association' AS INT)) + max(CAST(lane = 'lexical' AS INT)) + max(CAST(lane = 'graph' AS INT)) AS lanes, coalesce(max(score) FILTER (WHERE lane = 'lexical'), 0) AS best,
                 count(DISTINCT support) FILTER (WHERE lane = 'lexical') AS lexical_hits, count(DISTINCT support) FILTER (WHERE lane = 'graph') AS graph_hits FROM l GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY mention ORDER BY exact DESC, normalized DESC, alias DESC, lanes DESC, best DESC, lexical_hits DESC, graph_hits DESC, id) AS place FROM f QUALIFY place <= 8""")
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most eight nations a supplier: by surface, by a region that it is associated with, by customers
    who bought much of it (the discount stands for the likeness of a statement) or little (neighbours)."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    lane = lambda df, name, support=None, score=None: df.select("mention", F.col("id").cast("int").alias("id"), F.lit(name).alias("lane") if name else F.col("lane"), (support if support is not None else F.lit(None)).cast("long").alias("support"), (score if score is not None else F.lit(None)).cast("double").alias("score"))
    linked = s.join(n, F.col("n_regionkey") == F.col("s_suppkey") % 5).select(F.col("s_suppkey").alias("mention"), F.col("n_nationkey").alias("id"))
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    bought = line.select(F.col("l_suppkey").alias("mention"), F.col("c_nationkey").alias("id"), "o_orderkey", "c_custkey", "l_discount", "l_quantity")
    lexical = lane(bought.where("l_quantity > 48"), "lexical", F.col("o_orderkey"), F.col("l_discount"))
    graph = lane(bought.where("l_quantity < 3"), "graph", F.col("c_custkey"))
    return e.ranked(lane(_lookup(spark, sf_dir), None).union(lane(linked, "association")).union(lexical).union(graph))


@query("entity_audit", f"""
    WITH en AS (SELECT p_partkey AS id, p_name AS name, p_type || ' ' || p_size AS alias, p_brand AS kind FROM part),
    nm AS (SELECT id, kind, name, false AS is_alias, {_LOOSE.format("name")} AS key FROM en UNION ALL SELECT id, kind, alias, true, {_LOOSE.format("alias")} FROM en),
    d AS (SELECT id, (SELECT count(*) FROM lineitem WHERE l_partkey = id AND l_quantity > 45) AS n FROM en),
    rs AS (SELECT o_orderkey AS mention, CASE o_orderstatus WHEN 'F' THEN 'rejected' WHEN 'O' THEN 'resolved' ELSE 'pending' END AS status, o_orderpriority AS reason, o_custkey * 3 AS target FROM orders)
    SELECT 'exact surface' AS finding, lower(trim(name)) || ':' || kind AS key, count(DISTINCT id) AS n FROM en GROUP BY lower(trim(name)), kind HAVING count(DISTINCT id) > 1
    UNION ALL SELECT 'normalized surface', key || ':' || kind, count(DISTINCT id) FROM nm WHERE NOT is_alias AND key <> '' GROUP BY key, kind HAVING count(DISTINCT id) > 1
    UNION ALL SELECT 'alias', key || ':' || kind, count(DISTINCT id) FROM nm WHERE key <> '' GROUP BY key, kind HAVING count(DISTINCT id) > 1
    UNION ALL SELECT 'alias of another kind', key, count(DISTINCT id) FROM nm WHERE key <> '' GROUP BY key HAVING count(DISTINCT kind) > 1 AND bool_or(is_alias)
    UNION ALL SELECT 'no edges', CAST(id AS VARCHAR), 0 FROM d WHERE n = 0
    UNION ALL SELECT 'degree', CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'one' WHEN n >= 3 THEN 'three or more' ELSE 'two' END, count(*) FROM d GROUP BY 2
    UNION ALL SELECT 'status', status, count(*) FROM rs GROUP BY 2 UNION ALL SELECT 'reason', reason, count(*) FROM rs GROUP BY 2
    UNION ALL SELECT 'rejected without cause', CAST(mention AS VARCHAR), 1 FROM rs WHERE status = 'rejected' AND reason NOT LIKE '1%'
    UNION ALL SELECT 'target missing', CAST(mention AS VARCHAR), 1 FROM rs WHERE status = 'resolved' AND target NOT IN (SELECT id FROM en)""")
def entity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities with a type and size as alias, orders as resolutions; only the first priority rejects."""
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    en = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_type", "p_size")).alias("aliases"), F.col("p_brand").alias("kind"))
    edges = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    status = F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "O", "resolved").otherwise("pending")
    first = [r[0] for r in o.select("o_orderpriority").distinct().collect() if r[0].startswith("1")]  # a handful of priorities
    return e.audit(en, edges, o.select(F.col("o_orderkey").alias("mention"), status.alias("status"), F.col("o_orderpriority").alias("reason"), (F.col("o_custkey") * 3).alias("target")), first)


@query("block_pairs", """
    WITH cl AS (SELECT p_partkey AS id, p_brand AS kind, p_retailprice AS claim FROM part), x AS (SELECT a.id AS left_id, b.id AS right_id, CAST(65535 AS BIGINT) AS score FROM cl a JOIN cl b ON a.kind = b.kind AND a.claim = b.claim AND a.id < b.id),
    t AS (SELECT p_partkey AS id, p_brand AS kind, list_filter(list_distinct(list_transform(regexp_extract_all(p_name || ' ' || p_type, '[\\p{L}\\p{N}]+'), lambda x: lower(x))),
                  lambda x: strlen(x) >= 4 AND x NOT IN ('client','code','game','library','module','package','project','repo','repository','server','service','system','tool')) AS tokens FROM part),
    p AS (SELECT id, kind, unnest(tokens) AS token FROM t), b AS (SELECT kind, token FROM p GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 32),
    pr AS (SELECT DISTINCT x.id AS left_id, y.id AS right_id FROM p x JOIN b USING (kind, token) JOIN p y USING (kind, token) WHERE x.id < y.id),
    s AS (SELECT left_id, right_id, len(list_intersect(a.tokens, c.tokens)) AS i, len(a.tokens) AS na, len(c.tokens) AS nc FROM pr JOIN t a ON a.id = left_id JOIN t c ON c.id = right_id)
    SELECT left_id, right_id, max(score) AS score FROM (SELECT left_id, right_id, CAST(i * 1000 // (na + nc - i) AS BIGINT) AS score FROM s WHERE i * 1000 // (na + nc - i) >= 330 OR i = na OR i = nc UNION ALL SELECT * FROM x) GROUP BY 1, 2""")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand whose names and types share tokens, or whose prices (exact claims) are equal."""
    p = table(spark, sf_dir, "part")
    return e.block_pairs(p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_brand").alias("kind")), p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("claim")))


@query("entity_merge", """
    WITH m AS (SELECT s_suppkey AS id, s_suppkey - s_suppkey % 10 AS into_ FROM supplier WHERE s_suppkey % 10 IN (1, 2) AND s_suppkey > 10),
    e AS (SELECT DISTINCT l_suppkey AS source, l_suppkey % 7 + 20 AS target FROM lineitem)
    SELECT DISTINCT coalesce(a.into_, source) AS source, coalesce(b.into_, target) AS target FROM e LEFT JOIN m a ON a.id = source LEFT JOIN m b ON b.id = target
    WHERE coalesce(a.into_, source) <> coalesce(b.into_, target)""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after suppliers ending in 1 and 2 were merged into the one ending in 0."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") - F.col("s_suppkey") % 10).alias("into")).where("id % 10 in (1, 2) and id > 10")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_suppkey") % 7 + 20).alias("target")).distinct()
    return e.merged(s.select("id", F.lit("x").alias("alias")), edges, s)[1]


@query("resolution_compaction", """
    WITH r AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'pending' WHEN event_type = 'click' THEN 'dormant' ELSE 'resolved' END AS status,
                      CAST(event_id % 200 AS BIGINT) AS updated_day, user_id % 9 <> 0 AS active FROM events)
    SELECT event_id, CASE WHEN NOT active THEN 'purged' WHEN status = 'pending' AND 200 - updated_day >= 30 THEN 'dormant'
           WHEN status = 'dormant' AND 200 - updated_day >= 180 THEN 'purged' ELSE status END AS next FROM r""")
def resolution_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "dormant").otherwise("resolved")
    r = ev.select("event_id", status.alias("status"), (F.col("event_id") % 200).alias("updated_day"), (F.col("user_id") % 9 != 0).alias("active"), F.lit(200).alias("now"))
    return e.resolution_states(r, "now").select("event_id", "next")


@query("resolution_decisions", """
    WITH a AS (SELECT event_id, (90 + event_id % 10) / CAST(100 AS DOUBLE) AS p, (event_id % 97) / CAST(100 AS DOUBLE) AS second, event_id % 2 = 0 AS exact, event_id % 3 = 0 AS normalized FROM events)
    SELECT event_id, p >= 0.95 AND p - second >= CAST(0.15 AS DOUBLE) - 1e-12 AND (exact OR normalized) AS accepted FROM a""")
def resolution_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    a = table(spark, sf_dir, "events").select(i, ((90 + i % 10) / F.lit(100.0)).alias("p"), ((i % 97) / F.lit(100.0)).alias("second"), (i % 2 == 0).alias("exact"), (i % 3 == 0).alias("normalized"))
    return e.decided(a).select("event_id", "accepted")


@query("entities_of_memory", """
    WITH a AS (SELECT DISTINCT o_custkey AS memory, l_suppkey AS entity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R')
    SELECT memory AS id, 'entities' AS side, string_agg(CAST(entity AS VARCHAR), ',' ORDER BY entity) AS ids FROM a WHERE memory % 10 = 1 GROUP BY 1
    UNION ALL SELECT entity, 'memories', string_agg(CAST(memory AS VARCHAR), ',' ORDER BY memory) FROM a WHERE entity % 10 = 1 GROUP BY 1""")
def entities_of_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of every tenth customer and the customers of every tenth supplier, sorted."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return e.associated(line.select(F.col("o_custkey").alias("memory"), F.col("l_suppkey").alias("entity")), "memory % 10 = 1", "entity % 10 = 1")


_ENTITIES_SQL = """s AS (SELECT s_suppkey AS n, 'e' || s_suppkey AS id, s_suppkey % 10 AS k, s_name AS name FROM supplier)"""


def _entity_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers, as entities of one revision each, and tombstones of those that end in 9."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.concat(F.lit("e"), "s_suppkey").alias("id"), (F.col("s_suppkey") % 10).alias("k"), F.col("s_name").alias("name"))
    log = s.select("id", F.lit(1).alias("revision"), F.concat(F.lit("m"), "n").alias("mutation_id"), "name", F.array().cast("array<string>").alias("aliases"), F.lit("firm").alias("kind"), F.lit(5).cast("long").alias("created_ns"))
    return s, log, s.where("k = 9").select("id", F.lit(2).alias("revision"), F.lit("e1").alias("replacement_id"))


@query("entity_publish", f"""WITH {_ENTITIES_SQL}
    SELECT CASE WHEN k IN (1, 2) THEN 'm' || n ELSE 'd' || n END AS mutation_id, CASE WHEN k = 6 THEN sha256('entity/' || length('d' || n) || ':d' || n) ELSE id END AS id,
        ['written', 'repeated', 'conflict', 'stale', 'changed', 'invalid', 'new', 'contested', 'stale', 'revived'][k + 1] AS outcome, CASE k WHEN 0 THEN 2 WHEN 6 THEN 1 WHEN 9 THEN 3 END AS revision FROM s
    UNION ALL SELECT 'x' || n, id, 'contested', NULL FROM s WHERE k = 7""")
def entity_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of ten kinds, by a supplier's last digit."""
    s, log, gone = _entity_log(spark, sf_dir)
    k = F.col("k")
    draft = lambda mutation: s.select(
        "k", mutation.alias("mutation_id"), F.when(k != 6, F.col("id")).alias("id"), F.when(k.isin(3, 6), 0).when(k == 9, 2).when(k != 8, 1).alias("expected_revision"),
        F.when(k == 2, "another").when(k == 5, " \t").otherwise(F.col("name")).alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("firm").alias("kind"), F.when(k == 4, 6).otherwise(5).cast("long").alias("created_ns"),
    )
    drafts = draft(F.concat(F.when(k.isin(1, 2), "m").otherwise("d"), "n")).union(draft(F.concat(F.lit("x"), "n")).where("k = 7")).drop("k")
    return e.published(log, gone, drafts).select("mutation_id", "id", "outcome", "revision")


@query("entity_tombstones", f"""WITH {_ENTITIES_SQL}, c AS (
        SELECT id, k, n, CASE k WHEN 4 THEN 7 ELSE 1 END AS expected_revision, CASE WHEN k IN (0, 5, 8) THEN 'e' || (n + 1) WHEN k = 2 THEN id WHEN k = 3 THEN 'nobody' WHEN k = 9 AND n % 20 = 19 THEN 'e11' ELSE 'e1' END AS replacement_id FROM s WHERE k <> 1
        UNION ALL SELECT id, k, n, 1, 'e11' FROM s WHERE k = 7),
    j AS (SELECT c.*, c.id <> replacement_id AND EXISTS (SELECT 1 FROM s WHERE s.id = replacement_id AND s.k <> 9) AS there FROM c)
    SELECT id, expected_revision, replacement_id, CASE WHEN NOT there THEN 'invalid' WHEN k = 9 AND replacement_id = 'e1' THEN 'repeated' WHEN k = 9 THEN 'missing' WHEN k = 4 THEN 'stale' WHEN k IN (5, 7) THEN 'contested' ELSE 'written' END AS outcome,
        CASE WHEN there AND k IN (0, 6) THEN 2 END AS revision FROM j""")
def entity_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities to be replaced by others: themselves, none, one that is retired too, of another revision, twice."""
    s, log, gone = _entity_log(spark, sf_dir)
    k = F.col("k")
    to = F.when(k.isin(0, 5, 8), F.concat(F.lit("e"), F.col("n") + 1)).when(k == 2, F.col("id")).when(k == 3, "nobody").when((k == 9) & (F.col("n") % 20 == 19), "e11").otherwise("e1")
    commands = s.where("k <> 1").select("id", F.when(k == 4, 7).otherwise(1).alias("expected_revision"), to.alias("replacement_id")).union(s.where("k = 7").select("id", F.lit(1), F.lit("e11")))
    return e.tombstoned(log, gone, commands.union(commands))


@query("claim_classes", """
    WITH c AS (SELECT p_partkey AS id, p_brand AS kind, p_retailprice AS claim FROM part WHERE p_retailprice IS NOT NULL)
    SELECT id, claim, min(id) OVER w AS first, count(*) OVER w AS members FROM c WINDOW w AS (PARTITION BY kind, claim) QUALIFY members > 1""")
def claim_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand that have one price: each with its class."""
    p = table(spark, sf_dir, "part")
    return e.claim_classes(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind")), p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("claim")))
