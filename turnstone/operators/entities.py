"""Entities: surfaces and aliases, candidates by lanes, audit, blocking, resolution states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_trimmed, identity_tokens, jaccard_per_mille, normalize_surface, normalized_surface
from .records import identifier

# Words that say nothing about which entity is meant.
GENERIC = ["client", "code", "game", "library", "module", "package", "project", "repo", "repository", "server", "service", "system", "tool"]
#: Members of a token's block at most; larger blocks make no pairs (a rule of the operator).
MOST_IN_BLOCK = 32
LEAST_JACCARD, EXACT_SCORE = 330, 65535


def surfaces(entities: DataFrame) -> DataFrame:
    """(key, id, lane) of entities (id, name, aliases): the exact, normalized and alias keys of each."""
    names = entities.select("id", F.explode(F.concat(F.array(F.struct("name", F.lit(True).alias("own"))), F.transform("aliases", lambda a: F.struct(a.alias("name"), F.lit(False).alias("own"))))).alias("s"))
    exact = names.select(normalize_surface(F.col("s.name")).alias("key"), "id", F.lit("exact").alias("lane"))
    loose = names.select(normalized_surface(F.col("s.name")).alias("key"), "id", F.lit("normalized").alias("lane"))
    alias = names.select(F.explode(alias_keys(F.col("s.name"))).alias("key"), "id", F.lit("alias").alias("lane"))
    return exact.union(loose).union(alias).where("key <> ''").distinct()


def alias_keys(name: Column) -> Column:
    """`repository:x` for `X repo`, `X repository` or a URL's last part; `acronym:x` for capitals (with a
    plural s) alone or before a name, 2 to 4 of them."""
    repo = F.regexp_extract(name, r"(?i)^\s*(\S+)\s+repo(?:sitory)?\s*$", 1)
    url = F.regexp_extract(name, r"(?i)^\s*https?://\S*/([^/\s]+?)(?:\.git)?/?\s*$", 1)
    word = F.regexp_extract(name, r"^\s*([A-Z]{2,})s?\s*$", 1)
    prefix = F.regexp_extract(name, r"^\s*([A-Z]{2,4})\s+\S", 1)
    key = lambda kind, x: F.when(x != "", F.concat(F.lit(f"{kind}:"), F.lower(x)))
    return F.array_distinct(F.array_compact(F.array(key("repository", repo), key("repository", url), key("acronym", word), key("acronym", prefix))))


def looked_up(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """(mention, id, lane) of mentions (mention, surface)."""
    m = mentions.select("mention", "surface")
    keys = F.concat(
        F.array(F.struct(F.lit("exact").alias("lane"), normalize_surface(F.col("surface")).alias("key")), F.struct(F.lit("normalized").alias("lane"), normalized_surface(F.col("surface")).alias("key"))),
        F.transform(alias_keys(F.col("surface")), lambda k: F.struct(F.lit("alias").alias("lane"), k.alias("key"))),
    )
    return m.select("mention", F.explode(keys).alias("k")).select("mention", "k.lane", "k.key").join(index, ["lane", "key"]).select("mention", "id", "lane").distinct()


def ranked(lanes: DataFrame, most: int = 8) -> DataFrame:
    """(mention, id, exact, normalized, alias, lanes, best, lexical_hits, graph_hits, place): evidence of
    all lanes (mention, id, lane, support, score) put together, the best `most` of each mention.

    Lanes: exact, normalized, alias (by surface), association (of the source), lexical (statements that
    are like the context, with their scores) and graph (neighbours); support names a statement. Order:
    by surface, then how many other lanes there are, the best lexical score, lexical and graph hits, id.
    """
    has = lambda lane: F.max(F.when(F.col("lane") == lane, 1).otherwise(0))
    hits = lambda lane: F.count_distinct(F.when(F.col("lane") == lane, F.col("support")))
    facts = lanes.groupBy("mention", "id").agg(
        has("exact").alias("exact"), has("normalized").alias("normalized"), has("alias").alias("alias"), (has("association") + has("lexical") + has("graph")).alias("lanes"),
        F.coalesce(F.max(F.when(F.col("lane") == "lexical", F.col("score"))), F.lit(0.0)).alias("best"), hits("lexical").alias("lexical_hits"), hits("graph").alias("graph_hits"),
    )
    keys = ("exact", "normalized", "alias", "lanes", "best", "lexical_hits", "graph_hits")
    order = Window.partitionBy("mention").orderBy(*(F.desc(k) for k in keys), "id")
    return facts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def audit(entities: DataFrame, edges: DataFrame, resolutions: DataFrame, rejecting: list[str] | None = None) -> DataFrame:
    """(finding, key, n): what an audit finds of entities (id, name, aliases, kind), edges (id) and
    resolutions (mention, status, reason, target).

    Surfaces that several entities of a kind share: exact names, normalized names, and any of names and
    aliases; aliases that are another kind's name or alias; entities without edges; counts of entities
    by degree, and of resolutions by status and by reason; rejections for a reason that doesn't reject
    (`rejecting` does), and resolved ones whose target isn't there.
    """
    find = lambda df, name, key, n: df.select(F.lit(name).alias("finding"), F.col(key).cast("string").alias("key"), n.cast("long").alias("n"))
    names = entities.select("id", "kind", F.explode(F.concat(F.array(F.struct(F.col("name"), F.lit(False).alias("alias"))), F.transform("aliases", lambda a: F.struct(a.alias("name"), F.lit(True).alias("alias"))))).alias("s"))
    names = names.select("id", "kind", F.col("s.name").alias("name"), F.col("s.alias").alias("alias"), normalized_surface(F.col("s.name")).alias("key"))
    shared = lambda df, key, name: find(df.groupBy("kind", key).agg(F.count_distinct("id").alias("n")).where("n > 1").withColumn("key", F.concat_ws(":", key, "kind")), name, "key", F.col("n"))
    own = names.where("not alias").withColumn("exact", normalize_surface(F.col("name")))
    shadows = names.where("key <> ''").groupBy("key").agg(F.count_distinct("kind").alias("kinds"), F.max("alias").alias("any"), F.count_distinct("id").alias("n")).where("kinds > 1 and any")
    degree = entities.select("id").join(edges.groupBy("id").agg(F.count("*").alias("n")), "id", "left").na.fill(0, ["n"])
    sums = degree.groupBy(F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").when(F.col("n") >= 3, "three or more").otherwise("two").alias("k")).agg(F.count("*").alias("n"))
    wrong = resolutions.where((F.col("status") == "rejected") & ~F.coalesce(F.col("reason").isin(rejecting or []), F.lit(False)))
    lost = resolutions.where(F.col("status") == "resolved").join(entities.select(F.col("id").alias("target")), "target", "left_anti")
    out = shared(own, "exact", "exact surface")
    for part in (
        shared(own.where("key <> ''"), "key", "normalized surface"),
        shared(names.where("key <> ''"), "key", "alias"),
        find(shadows, "alias of another kind", "key", F.col("n")),
        find(degree.where("n = 0"), "no edges", "id", F.lit(0)),
        find(sums, "degree", "k", F.col("n")),
        find(resolutions.groupBy("status").agg(F.count("*").alias("n")), "status", "status", F.col("n")),
        find(resolutions.groupBy("reason").agg(F.count("*").alias("n")), "reason", "reason", F.col("n")),
        find(wrong, "rejected without cause", "mention", F.lit(1)),
        find(lost, "target missing", "mention", F.lit(1)),
    ):
        out = out.union(part)
    return out


def block_pairs(entities: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, score) of entities (id, name, kind) of one kind: those with an equal exact
    claim (id, claim) score 65535, however many there are; those that share a token in a block of at most 32, by token overlap
    in thousandths if it is 330 or more or one's tokens are all the other's."""
    tokens = entities.select("id", "kind", identity_tokens(F.col("name"), GENERIC).alias("tokens")).where(F.size("tokens") > 0)
    posted = tokens.select("id", "kind", F.explode("tokens").alias("token"))
    small = posted.groupBy("kind", "token").agg(F.count("*").alias("n")).where(F.col("n").between(2, MOST_IN_BLOCK)).select("kind", "token")
    block = posted.join(small, ["kind", "token"])
    pairs = block.withColumnRenamed("id", "left_id").join(block.withColumnRenamed("id", "right_id"), ["kind", "token"]).where("left_id < right_id").select("left_id", "right_id").distinct()
    side = lambda name: tokens.select(F.col("id").alias(f"{name}_id"), F.col("tokens").alias(f"{name}_tokens"))
    a, b = F.col("left_tokens"), F.col("right_tokens")
    score = jaccard_per_mille(a, b)
    subset = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    found = pairs.join(side("left"), "left_id").join(side("right"), "right_id").select("left_id", "right_id", score.alias("score"), subset.alias("subset")).where((F.col("score") >= LEAST_JACCARD) | F.col("subset")).drop("subset")
    if claims is not None:
        # rows of a claim meet by a join, which Spark splits where many share it; no claim is one row
        c = claims.where("claim is not null").join(entities.select("id", "kind"), "id").select("kind", "claim", "id").distinct()
        both = c.withColumnRenamed("id", "left_id").join(c.withColumnRenamed("id", "right_id"), ["kind", "claim"]).where("left_id < right_id")
        found = found.union(both.select("left_id", "right_id", F.lit(EXACT_SCORE).cast("long")))
    return found.groupBy("left_id", "right_id").agg(F.max("score").alias("score"))


def merged(aliases: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aliases, edges, tombstones) after merges (id, into): aliases (id, alias) and edge ends are moved
    to the entity that stays; loops and repeated rows go."""
    to = lambda df, c: df.join(merges.select(F.col("id").alias(c), "into"), c, "left").withColumn(c, F.coalesce("into", c)).drop("into").select(df.columns)
    moved = to(to(edges, "source"), "target").where("source <> target").distinct()
    return to(aliases, "id").distinct(), moved, merges.select("id", F.col("into").alias("replacement_id"))


def resolution_states(pending: DataFrame, now: str, dormant_after: int = 30, purge_after: int = 180) -> DataFrame:
    """pending (status, updated_day, active) with next: pending for 30 days becomes dormant, dormant for
    180 is purged, and so is what has an inactive source."""
    age = F.col(now) - F.col("updated_day")
    nxt = (
        F.when(~F.col("active"), "purged")
        .when((F.col("status") == "pending") & (age >= dormant_after), "dormant")
        .when((F.col("status") == "dormant") & (age >= purge_after), "purged")
        .otherwise(F.col("status"))
    )
    return pending.withColumn("next", nxt)


def decided(answers: DataFrame) -> DataFrame:
    """answers (p, second, exact, normalized) with accepted: p of at least .95, a margin of .15, and an
    exact or normalized surface."""
    ok = (F.col("p") >= 0.95) & (F.col("p") - F.col("second") >= 0.15 - 1e-12) & (F.col("exact") | F.col("normalized"))
    return answers.withColumn("accepted", ok)


def associated(links: DataFrame, memories: str, entities: str) -> DataFrame:
    """(id, side, ids): sorted ids of the entities of some memories, and of the memories of some entities,
    of links (memory, entity); the two conditions pick which."""
    once = links.select("memory", "entity").distinct()
    side = lambda of, other, name, which: once.where(which).groupBy(F.col(of).alias("id")).agg(F.lit(name).alias("side"), F.array_join(F.transform(F.array_sort(F.collect_list(other)), lambda x: x.cast("string")), ",").alias("ids"))
    return side("memory", "entity", "entities", memories).union(side("entity", "memory", "memories", entities))


def claim_classes(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, claim, first, members) of entities (id, kind) whose claim (id, claim) others of their kind have:
    the least id of the class and how many it has. A row a member stands for all pairs of the class."""
    c = claims.where("claim is not null").join(entities.select("id", "kind"), "id").select("kind", "claim", "id").distinct()
    classes = c.groupBy("kind", "claim").agg(F.min("id").alias("first"), F.count("*").alias("members")).where("members > 1")
    return c.join(classes, ["kind", "claim"]).select("id", "claim", "first", "members")


_DRAFT = ("name", "aliases", "kind", "created_ns")


def _revisions(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(id, _revision, _is, _created): the last revision of each entity and whether it is a record."""
    both = log.select("id", "revision", F.lit(True).alias("is"), "created_ns").union(tombstones.select("id", "revision", F.lit(False), F.lit(None).cast("long")))
    return both.groupBy("id").agg(F.max("revision").alias("_revision"), F.max_by("is", "revision").alias("_is"), F.max_by("created_ns", "revision").alias("_created"))


def published(log: DataFrame, tombstones: DataFrame, drafts: DataFrame) -> DataFrame:
    """drafts (mutation_id, id, expected_revision, name, aliases, kind, created_ns) with id, outcome and revision.

    log: (id, revision, mutation_id) and the last four; tombstones: (id, revision, replacement_id). A draft
    without an id gets one by its mutation. Outcomes: `invalid` (a blank name); `repeated`, a mutation of the
    log that says the same of an entity that is there, else `conflict`; `contested`, if the batch names an
    entity or a mutation more than once; `stale`, if another revision is the last one; `changed`, if the
    time of creation differs; `new`, `revived` (of a retired entity) or `written`, which have a revision.
    """
    drafts = drafts.withColumn("id", F.coalesce("id", identifier("entity", F.col("mutation_id"))))
    count = lambda key, name: drafts.groupBy(key).agg(F.count("*").alias(name))
    own, said = F.to_json(F.struct(*_DRAFT)), log.select("mutation_id", F.col("id").alias("_of"), F.to_json(F.struct(*_DRAFT)).alias("_said"))
    last = _revisions(log, tombstones)
    there = last.where("_is").select(F.col("id").alias("_of"), F.lit(True).alias("_there"))
    rows = drafts.join(count("id", "_ids"), "id").join(count("mutation_id", "_mutations"), "mutation_id").join(said.join(there, "_of", "left"), "mutation_id", "left").join(last, "id", "left")
    outcome = (
        F.when(F.coalesce(blank_trimmed(F.col("name")), F.lit("")) == "", "invalid")
        .when(F.col("_of").isNotNull(), F.when(F.coalesce("_there", F.lit(False)) & (F.col("_said") == own), "repeated").otherwise("conflict"))
        .when((F.col("_ids") > 1) | (F.col("_mutations") > 1), "contested")
        .when(~F.col("expected_revision").eqNullSafe(F.coalesce("_revision", F.lit(0))), "stale")
        .when(F.col("_is") & (F.col("_created") != F.col("created_ns")), "changed")
        .when(F.col("_revision").isNull(), "new").when(F.col("_is"), "written").otherwise("revived")
    )
    rows = rows.withColumn("outcome", outcome)
    return rows.select(*drafts.columns, "outcome", F.when(F.col("outcome").isin("new", "written", "revived"), F.coalesce("_revision", F.lit(0)) + 1).alias("revision"))


def tombstoned(log: DataFrame, tombstones: DataFrame, commands: DataFrame) -> DataFrame:
    """commands (id, expected_revision, replacement_id), equal ones once, with outcome and revision.

    Outcomes: `invalid`, if the replacement is the entity itself or isn't there; `repeated`, if the entity has
    been retired for that replacement, `missing`, if it isn't there otherwise; `stale`, if it has another
    revision; `contested`, if the batch names the entity again or would retire its replacement; `written`.
    """
    last = _revisions(log, tombstones).select("id", "_revision", "_is")
    commands = commands.select("id", "expected_revision", "replacement_id").distinct()
    named = commands.groupBy("id").agg(F.count("*").alias("_named"))
    there = last.where("_is").select(F.col("id").alias("replacement_id"), F.lit(True).alias("_there"))
    also = named.select(F.col("id").alias("replacement_id"), F.lit(True).alias("_also"))
    into = tombstones.groupBy("id").agg(F.max_by("replacement_id", "revision").alias("_into"))
    rows = commands.join(named, "id").join(there, "replacement_id", "left").join(also, "replacement_id", "left").join(last, "id", "left").join(into, "id", "left")
    outcome = (
        F.when((F.col("id") == F.col("replacement_id")) | F.col("_there").isNull(), "invalid")
        .when(~F.coalesce("_is", F.lit(False)), F.when(F.col("_into").eqNullSafe(F.col("replacement_id")), "repeated").otherwise("missing"))
        .when(~F.col("expected_revision").eqNullSafe(F.col("_revision")), "stale")
        .when((F.col("_named") > 1) | F.col("_also").isNotNull(), "contested")
        .otherwise("written")
    )
    return rows.withColumn("outcome", outcome).select(*commands.columns, "outcome", F.when(F.col("outcome") == "written", F.col("_revision") + 1).alias("revision"))
