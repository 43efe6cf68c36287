"""Queries of admission: composed names, mentions and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import admission as a
from ..operators import extraction as x
from .lexical import _TOKENS
from .tables import TURNS_SQL, turns


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of their brand; every 20th is a language whose name is the first word."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    name = F.when(k % 20 == 0, first).when(k % 3 == 0, F.concat(F.initcap(F.regexp_replace("p_name", " ", "x")), F.lit("Package"))).when(k % 3 == 1, F.concat(F.lit("lib/"), "p_name")).otherwise(F.col("p_name"))
    return p.select(k.alias("id"), name.alias("name"), F.array(F.concat("p_type", F.lit(" module"))).alias("aliases"), F.when(k % 20 == 0, "programming_language").otherwise(F.col("p_brand")).alias("kind"))


_ENTITIES_SQL = """en AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 20 = 0 THEN split_part(p_name, ' ', 1) WHEN p_partkey % 3 = 0 THEN upper(p_name[1]) || replace(p_name, ' ', 'x')[2:] || 'Package' WHEN p_partkey % 3 = 1 THEN 'lib/' || p_name ELSE p_name END AS name,
        p_type || ' module' AS alias, CASE WHEN p_partkey % 20 = 0 THEN 'programming_language' ELSE p_brand END AS kind FROM part),
    q AS (SELECT DISTINCT lower(name) AS word FROM en WHERE kind = 'programming_language')"""


def _keys_sql(source: str, out: str) -> str:
    """DuckDB: out AS (id, key) of source (id, name), for names of plain letters."""
    return f"""{out}0 AS (SELECT id, unnest(list_distinct([name, list_last(string_split(name, '/'))])) AS name FROM {source}),
    {out}1 AS (SELECT id, list_transform(regexp_extract_all(regexp_replace(name, '([a-z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM {out}0),
    {out} AS (SELECT id, array_to_string(w, '') AS key FROM {out}1 WHERE len(w) > 0 UNION SELECT id, array_to_string(w[1:len(w) - 1], '') FROM {out}1 WHERE len(w) > 1 AND w[len(w)] IN ('package', 'module', 'component')
        UNION SELECT id, array_to_string(w[2:], '') FROM {out}1 JOIN q ON q.word = w[1] WHERE len(w) > 1)"""


@query("identity_keys", f"WITH {_ENTITIES_SQL}, nm AS (SELECT id, name FROM en), {_keys_sql('nm', 'k')} SELECT id, key FROM k")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys by which parts are taken for one another."""
    e = _entities(spark, sf_dir)
    return a.guard_keys(e.select("id", "name"), a.qualifiers(e))


@query("creation_conflicts", f"""
    WITH {_ENTITIES_SQL}, mt AS (SELECT l_orderkey * 8 + l_linenumber AS id, 'services/' || p_name || ' component' AS name, p_brand AS kind FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1),
    nm AS (SELECT id, name FROM en UNION ALL SELECT id, alias FROM en), {_keys_sql('nm', 'k')}, {_keys_sql('mt', 'mk')},
    h AS (SELECT DISTINCT mt.id AS mention, en.id FROM mt JOIN mk USING (id) JOIN k ON k.key = mk.key JOIN en ON en.id = k.id AND en.kind = mt.kind)
    SELECT mention, id, row_number() OVER (PARTITION BY mention ORDER BY id) AS place FROM h QUALIFY place <= 5""")
def creation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of orders mention `services/<part> component`: entities of the brand in their way."""
    line, p = table(spark, sf_dir, "lineitem").where("l_linenumber = 1"), table(spark, sf_dir, "part")
    m = line.join(p, F.col("p_partkey") == F.col("l_partkey")).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mention"), F.concat(F.lit("services/"), "p_name", F.lit(" component")).alias("surface"), F.col("p_brand").alias("kind"))
    return a.creation_conflicts(m, _entities(spark, sf_dir), 5)


@query("admission_gates", """
    WITH m AS (SELECT event_id, event_id % 12 AS k, event_type, user_id FROM events)
    SELECT event_id, CASE k WHEN 0 THEN 'generic' WHEN 1 THEN 'generic' WHEN 2 THEN 'transient' WHEN 3 THEN 'transient' WHEN 4 THEN 'transient' WHEN 5 THEN 'transient' WHEN 6 THEN 'transient'
           WHEN 7 THEN 'incomplete' WHEN 8 THEN 'category' WHEN 9 THEN 'open' WHEN 10 THEN CASE WHEN user_id % 2 = 1 THEN 'incomplete' WHEN user_id % 5 IN (2, 4) THEN 'recurrence' ELSE 'open' END
           ELSE CASE WHEN user_id % 5 = 3 THEN 'transient' WHEN user_id % 2 = 1 THEN 'incomplete' WHEN user_id % 5 = 4 THEN 'recurrence' ELSE 'open' END END AS gate FROM m""")
def admission_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve sorts of mentions made of events, each with the gate that must close on it."""
    ev, k = table(spark, sf_dir, "events"), F.col("event_id") % 12
    n = F.col("event_id").cast("string")
    surface = (
        F.when(k == 0, "The Server").when(k == 1, " data ").when(k == 2, F.concat(F.lit("feature-"), n)).when(k == 3, F.concat(F.lit("commit "), F.substring(F.md5(n), 1, 12)))
        .when(k == 4, F.substring(F.md5(n), 1, 10)).when(k == 5, F.concat(F.lit("Build #"), n)).when(k == 6, F.concat(F.lit("request id: r-"), n, F.lit("-x"))).otherwise(F.concat(F.lit("Thing "), n))
    )
    context = F.when(k == 2, F.concat(F.lit("He pushed to the `feature-"), n, F.lit("` branch."))).when(k == 4, "The rollback went to that revision.").otherwise("Some words around.")
    kind = F.when(k == 7, "unknown").when(k == 8, "other").otherwise("product")
    summary = F.when(k == 8, "A broad concept in use.").when((k > 9) & (F.col("user_id") % 2 == 1), " ").otherwise("A thing.")
    rows = ev.select("event_id", "user_id", surface.alias("surface"), context.alias("context"), kind.alias("kind"), summary.alias("summary"))
    # users tell the gates apart that look at more than a surface
    u = F.col("user_id") % 5
    known, thing = u != 2, F.col("event_id") % 12 == 11
    rows = rows.withColumns({"summary": F.when(thing & (u == 3), F.concat(F.lit("A branch named "), F.lower("surface"), F.lit("."))).otherwise(F.col("summary")), "kind": F.when(thing & (u == 4), "enum_value").otherwise(F.col("kind"))})
    return a.admitted(rows.withColumns({"known": known & (u != 4), "recurs": F.col("event_id") % 12 == 10})).select("event_id", "gate")


@query("mentions_by_surface", """SELECT s_suppkey AS mention, n_name AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1""")
def mentions_by_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as mentions, looked up by the names of a region, in another case."""
    n = table(spark, sf_dir, "nation")
    m = table(spark, sf_dir, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("mention"), F.col("n_name").alias("text"))
    return a.mentions_by_surface(m, n.where("n_regionkey = 1").select(F.concat(F.lit(" "), F.lower("n_name")).alias("surface")))


_CONTEXT_SQL = f"""m AS (SELECT conversation_id, turn, content, role AS title, (conversation_id * 7 + turn * 13) % 40 AS off FROM turns),
    x AS (SELECT *, substr(content, off + 1, 12) AS text, substr(content, greatest(1, off - 95), least(off, 96)) AS before, substr(content, off + 13, 96) AS after FROM m)"""


#: All tokens in order; DuckDB's list_distinct keeps none.
_WORDS = "list_transform(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"


@query("context_query", f"""WITH {TURNS_SQL}, {_CONTEXT_SQL},
    t AS (SELECT conversation_id, turn, list_concat(list_concat({_WORDS.format("text")}, {_WORDS.format("title")}), {_WORDS.format("before || ' ' || after")}) AS w FROM x),
    u AS (SELECT conversation_id, turn, unnest(w) AS term, unnest(range(len(w))) AS p FROM t), f AS (SELECT conversation_id, turn, term, min(p) AS p FROM u GROUP BY ALL)
    SELECT conversation_id, turn, string_agg(term, ' ' ORDER BY p) FILTER (WHERE k <= 16) AS query FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, turn ORDER BY p) AS k FROM f) GROUP BY 1, 2""")
def context_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve characters of each turn as a mention: the terms of its context."""
    t = turns(spark, sf_dir)
    off = ((F.col("conversation_id") * 7 + F.col("turn") * 13) % 40).cast("int")
    text, before = F.substr("content", off + 1, F.lit(12)), F.substr("content", F.lit(1), off)
    start = F.octet_length(before)
    m = t.select("conversation_id", "turn", F.col("role").alias("title"), "content", text.alias("text"), F.lit("content").alias("field"), start.alias("start"), (start + F.octet_length(text)).alias("end"))
    return a.context_terms(m).where("query <> ''").select("conversation_id", "turn", "query")


@query("memory_contains_surface", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'the') OR contains(lower(source), 'the') OR contains(lower(coalesce(text, '')), 'src1') OR contains(lower(source), 'src1')")
def memory_contains_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold one of two surfaces in title or text; white space around a surface doesn't count."""
    d, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    return d.where(a.contains_surface(F.col("source"), text, F.lit("\u00a0tHe\t")) | a.contains_surface(F.col("source"), text, F.lit(" SRC1\n")) | a.contains_surface(F.col("source"), text, F.lit(" \t"))).select("doc_id")


@query("batch_resolution", """
    WITH m AS (SELECT s_suppkey AS mention, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE lower(n_name) || '!' END AS surface, n_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    k AS (SELECT mention, n_nationkey, n_nationkey < 10 AS known, min(mention) OVER (PARTITION BY n_nationkey) AS first FROM m)
    SELECT mention, CASE WHEN known THEN n_nationkey ELSE first END AS entity, CAST(CASE WHEN known OR mention = first THEN 1 ELSE 2 END AS INTEGER) AS wave FROM k""")
def batch_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as mentions; the first ten nations are known, others are made by the first mention."""
    n = table(spark, sf_dir, "nation")
    m = table(spark, sf_dir, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("mention"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lower("n_name"), F.lit("!"))).alias("surface"))
    known = n.where("n_nationkey < 10").select(a.normalized_surface(F.col("n_name")).alias("key"), F.col("n_nationkey").cast("long").alias("entity"))
    return a.resolved_in_waves(m, known)


_BLOCKS_SQL = """t AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS name, p_brand AS kind, list_filter(list_distinct(list_transform(regexp_extract_all(p_name || ' ' || p_type, '[\\p{L}\\p{N}]+'), lambda x: lower(x))),
        lambda x: strlen(x) >= 4 AND x NOT IN ('client','code','game','library','module','package','project','repo','repository','server','service','system','tool')) AS tokens FROM part),
    p AS (SELECT id, kind, unnest(tokens) AS token FROM t), b AS (SELECT kind, token FROM p GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 32),
    pr AS (SELECT DISTINCT x.id AS left_id, y.id AS right_id FROM p x JOIN b USING (kind, token) JOIN p y USING (kind, token) WHERE x.id < y.id),
    s AS (SELECT left_id, right_id, a.name, len(list_intersect(a.tokens, c.tokens)) AS i, len(a.tokens) AS na, len(c.tokens) AS nc FROM pr JOIN t a ON a.id = left_id JOIN t c ON c.id = right_id),
    g AS (SELECT left_id, right_id, name, CAST(i * 1000 // (na + nc - i) AS BIGINT) AS score FROM s WHERE i * 1000 // (na + nc - i) >= 330 OR i = na OR i = nc)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_brand").alias("kind"))


@query("reconciliation_pairs", f"WITH {_BLOCKS_SQL} SELECT left_id, right_id, score, row_number() OVER (ORDER BY score DESC, name, left_id, right_id) AS place FROM g QUALIFY place <= 100")
def reconciliation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred pairs of parts to be looked at first."""
    p = _parts(spark, sf_dir)
    return a.ordered_pairs(a.block_pairs(p), p, 100)


@query("entity_reconciliation", f"""WITH RECURSIVE {_BLOCKS_SQL}, y AS (SELECT left_id, right_id FROM g WHERE score = 1000 UNION ALL SELECT right_id, left_id FROM g WHERE score = 1000),
    r(id, other) AS (SELECT left_id, left_id FROM y UNION SELECT r.id, y.right_id FROM r JOIN y ON y.left_id = r.other), l AS (SELECT id, min(other) AS replacement_id FROM r GROUP BY id)
    SELECT id, replacement_id FROM l WHERE id <> replacement_id""")
def entity_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of pairing and merging; a stand-in for the model says that parts of equal tokens are one."""
    p = _parts(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    return a.reconciled(p, p.select("id", F.col("name").alias("alias")), line, lambda pairs: pairs.where("score = 1000"))[2]


@query("candidate_validation", f"""WITH {TURNS_SQL}
    SELECT conversation_id, turn, CASE turn WHEN 0 THEN CASE WHEN role = 'user' THEN '' ELSE 'not a user turn' END WHEN 1 THEN 'authority' WHEN 2 THEN 'category' WHEN 3 THEN 'type' WHEN 4 THEN 'empty' WHEN 5 THEN 'no source'
           WHEN 6 THEN CASE WHEN role = 'user' THEN 'receipt' ELSE 'not a user turn' END ELSE CASE WHEN role = 'user' THEN 'adoption without source' ELSE 'not a user turn' END END AS problem FROM turns""")
def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each turn, good or bad in a way of its own."""
    t, n = turns(spark, sf_dir), F.col("turn")
    c = t.select(
        "conversation_id", "turn", F.when(n == 1, "hearsay").when(n == 7, " Adoption ").otherwise("direct").alias("authority"), F.when(n == 2, "rumour").otherwise("FACT").alias("category"), F.when(n == 3, "mood").otherwise("project").alias("type"),
        F.when(n == 4, " \t").when(n == 6, "The tests passed").otherwise("A title").alias("title"), F.lit("What was said").alias("content"), F.substr("content", F.lit(1), F.lit(5)).alias("quote"), "role",
        F.when(n != 5, F.col("content")).alias("said"), F.lit("").alias("authority_source"), F.lit("").alias("grounding_source"), F.lit("current").alias("status"),
    )
    return c.withColumnRenamed("turn", "k").withColumnRenamed("said", "turn").withColumn("problem", x.candidate_problem()).select("conversation_id", F.col("k").alias("turn"), "problem")


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A stand-in model over conversations as episodes. Every second asks for its turn 1 and for what is
    like its first turn; every fourth, once it has evidence, for its turns 2 to 6. It makes a statement of
    each turn, of every third turn twice. Episodes are given whole, as the SQL has them."""
    t = turns(spark, sf_dir).select(F.col("conversation_id").alias("episode"), F.col("id").alias("turn_id"), F.col("turn").alias("position"), "role", "content")

    def ask(seen: DataFrame, evidence: DataFrame) -> DataFrame:
        first = seen.where("position = 0 and episode % 2 = 0")
        id_ = lambda k: F.concat_ws(":", "episode", k)
        one = first.select("episode", F.lit("turn").alias("kind"), id_(F.lit(1)).alias("value"), F.lit(1).alias("place"))
        two = first.select("episode", F.lit("search"), F.col("content"), F.lit(2))
        more = first.where("episode % 4 = 0").join(evidence.select("episode").distinct(), "episode").select("episode", F.explode(F.sequence(F.lit(2), F.lit(6))).alias("k"))
        return one.union(two).union(more.select("episode", F.lit("turn"), id_(F.col("k")), F.col("k") + 1))

    def make(seen: DataFrame, evidence: DataFrame) -> DataFrame:
        even = F.when(F.col("position") % 2 == 0, "Even").otherwise("odd")
        twice = seen.withColumn("again", F.explode(F.when(F.col("position") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        return twice.select(
            "episode", (F.col("position") * 2 + F.col("again")).alias("place"), "turn_id", F.lit("direct").alias("authority"), F.lit("fact").alias("category"), F.lit("other").alias("type"), F.lit("current").alias("status"), even.alias("title"),
            F.lit("Said so").alias("content"), F.left("content", F.lit(3)).alias("quote"), F.lit("").alias("authority_source"), F.lit("").alias("grounding_source"), F.lit("").alias("semantic_key"),
        )

    return x.extracted(t, ask, make, t.select("turn_id", "role", "content"), most_turns=None)


@query("extraction", f"""WITH {TURNS_SQL}, c AS (SELECT conversation_id AS episode, id AS turn_id, role, turn, unnest(CASE WHEN turn % 3 = 0 THEN [0, 1] ELSE [0] END) AS again FROM turns)
    SELECT episode, turn_id, turn * 2 + again AS place, CASE WHEN role <> 'user' THEN 'not a user turn' WHEN again = 1 THEN 'duplicate' ELSE '' END AS problem FROM c""")
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each candidate: accepted (no problem) or rejected with a reason."""
    yes, no, _ = _extracted(spark, sf_dir)
    own = ("episode", "turn_id", "place")
    return yes.select(*own, F.lit("").alias("problem")).union(no.select(*own, "problem"))


@query("extraction_ledger", f"""WITH {TURNS_SQL}, q AS (SELECT DISTINCT content AS value, {_TOKENS.format("content")} AS terms FROM turns WHERE turn = 0 AND conversation_id % 2 = 0),
    w AS (SELECT value, len(terms) AS n, unnest(terms) AS term FROM q), p AS (SELECT id, lower(content) AS low, unnest({_TOKENS.format("content")}) AS term FROM turns), h AS (SELECT DISTINCT value, id FROM w JOIN p USING (term)),
    f AS (SELECT value, least(count(*), 5) AS found FROM h GROUP BY value), e AS (SELECT conversation_id AS episode, content FROM turns WHERE turn = 0 AND conversation_id % 2 = 0),
    r AS (SELECT episode, 1 AS round, 'turn' AS kind, episode || ':1' AS value, 'asked' AS outcome FROM e UNION ALL SELECT episode, 1, 'search', content, 'asked' FROM e
          UNION ALL SELECT episode, 2, 'turn', episode || ':' || k, CASE WHEN k > 3 THEN 'refused' ELSE 'asked' END FROM e, range(2, 7) t(k) WHERE episode % 4 = 0)
    SELECT r.episode, r.round, r.kind, r.value, CASE WHEN outcome = 'refused' THEN outcome WHEN n = 0 THEN 'nothing' ELSE 'answered' END AS outcome, n AS found
    FROM (SELECT r.*, CASE WHEN outcome = 'refused' THEN 0 WHEN kind = 'turn' THEN (SELECT count(*) FROM turns t WHERE t.id = r.value) ELSE coalesce((SELECT found FROM f WHERE f.value = r.value), 0) END AS n FROM r) r""")
def extraction_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model asked for in each round, and what it was given."""
    return _extracted(spark, sf_dir)[2]
