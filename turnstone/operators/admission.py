"""What may become an entity or a statement: identity keys and creation conflicts, gates, the context of a
mention, waves of resolution, reconciliation in rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, blank_trimmed, lexical_terms, normalize_surface, normalized_surface
from ..session import cut
from .entities import block_pairs, merged
from .graph import components

# Endings that name no entity of their own, and the kind whose names qualify others.
GENERIC_ENDINGS = ["package", "module", "component"]
QUALIFYING_KIND = "programming_language"
#: Terms of a mention's context, and characters on either side of it.
CONTEXT_TERMS, CONTEXT_CHARS = 16, 96
# Surfaces that are no names.
GENERIC_SURFACES = [
    "agent", "application", "assistant", "client", "code", "data", "deployment", "devtool", "documentation", "entry", "file", "flow", "implementation", "lane", "pipeline",
    "project", "repository", "request", "response", "script", "scripts", "server", "session", "shader", "state", "status", "system", "tool", "tooling", "user",
]
# Phrases of summaries that describe a category.
CATEGORY_PHRASES = ["category of", "general category", "class of systems", "class of tools", "class of applications", "broad concept", "general concept"]
# Phrases of summaries that describe something that passes, and kinds that must recur.
PASSING_PHRASES = [
    "source-control branch", "source control branch", "git branch", "temporary branch", "task branch", "temporary worktree", "task worktree",
    "benchmark run", "test run", "build instance", "deployment instance", "session instance", "dated snapshot",
]
RECURRING_KINDS = ["code_symbol", "enum_value", "input_action"]


# -- identity ---------------------------------------------------------------------------------


def identity_words(name: Column) -> Column:
    """Lower-case words of a name; a capital between small letters begins one."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})", " "), F.lit(f"({TOKEN})"), 1), F.lower)


def _forms(name: Column) -> Column:
    """Word lists of a name: the whole and its last path part."""
    parts = F.filter(F.split(name, r"[/\\]"), lambda p: F.trim(p) != "")
    return F.array_distinct(F.array(identity_words(name), identity_words(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))))


def guard_keys(names: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """(id, key): the identity keys of names (id, name): words put together; without a generic ending;
    without a first word that is a qualifier (word)."""
    forms = names.select("id", F.explode(_forms(F.col("name"))).alias("w")).where(F.size("w") > 0)
    q = qualifiers.select(F.col("word").alias("_q")).distinct()
    known = forms.withColumn("_first", F.element_at("w", 1)).join(q, F.col("_first") == F.col("_q"), "left")
    several = F.size("w") > 1
    keys = F.array_compact(
        F.array(
            F.array_join("w", ""),
            F.when(several & F.element_at("w", -1).isin(GENERIC_ENDINGS), F.array_join(F.slice("w", F.lit(1), F.greatest(F.lit(0), F.size("w") - 1)), "")),
            F.when(several & F.col("_q").isNotNull(), F.array_join(F.slice("w", F.lit(2), F.greatest(F.lit(0), F.size("w") - 1)), "")),
        )
    )
    return known.select("id", F.explode(keys).alias("key")).distinct()


def qualifiers(entities: DataFrame) -> DataFrame:
    """(word): names and aliases, of one word, of programming languages. entities: (id, name, aliases, kind)."""
    names = entities.where(F.col("kind") == QUALIFYING_KIND).select(F.explode(F.concat(F.array("name"), "aliases")).alias("n"))
    return names.select(identity_words(F.col("n")).alias("w")).where(F.size("w") == 1).select(F.element_at("w", 1).alias("word")).distinct()


def creation_conflicts(mentions: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """(mention, id, place): at most `most` entities (id, name, aliases, kind) of a mention's (mention,
    surface, kind) kind that share an identity key with it, by id. A mention that has several rows meets
    each of its kinds by each of its surfaces.

    Only the first `most` entities of a kind and key can be among the first of a mention, so the others
    are left out before anything meets. Distinct surfaces and kinds are few, however many mentions
    there are: these meet entities, and mentions are joined with what theirs have found.
    """
    words = cut(qualifiers(entities), "qualifiers")
    own = mentions.groupBy("mention").agg(F.collect_set("surface").alias("surfaces"), F.collect_set("kind").alias("kinds"))
    asked = cut(own.select("mention", F.explode("surfaces").alias("surface"), "kinds").select("mention", "surface", F.explode("kinds").alias("kind")), "asked")
    names = entities.select("id", F.explode(F.concat(F.array("name"), "aliases")).alias("name"))
    held = guard_keys(names, words).join(entities.select("id", "kind"), "id").distinct()
    nth = F.row_number().over(Window.partitionBy("kind", "key").orderBy("id"))
    held = held.withColumn("_n", nth).where(F.col("_n") <= most).groupBy("kind", "key").agg(F.collect_list("id").alias("_ids"))
    sorts = cut(asked.select("surface", "kind").distinct(), "sorts")
    keys = guard_keys(sorts.select(F.col("surface").alias("id")).distinct().withColumn("name", F.col("id")), words).withColumnRenamed("id", "surface")
    first = lambda lists: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists)))), 1, most)
    met = cut(sorts.join(keys, "surface").join(cut(held, "held"), ["kind", "key"]).groupBy("surface", "kind").agg(first("_ids").alias("_ids")), "met")
    found = asked.join(met, ["surface", "kind"]).groupBy("mention").agg(first("_ids").alias("_ids"))
    return found.select("mention", F.posexplode("_ids").alias("place", "id")).select("mention", "id", (F.col("place") + 1).alias("place"))


# -- gates ------------------------------------------------------------------------------------


def generic_surface(surface: Column) -> Column:
    """Whether a surface, with or without `the`, is a generic word."""
    return F.regexp_replace(F.lower(blank_trimmed(surface)), "^the ", "").isin(GENERIC_SURFACES)


def transient_surface(surface: Column, context: Column) -> Column:
    """Whether a surface names something that passes: a branch or worktree of the context, a commit, a
    numbered build or run, an id."""
    s, plain = F.lower(blank_trimmed(surface)), F.regexp_replace(F.lower(context), "[`'\"]", "")
    beside = F.lit(False)
    for kind in ("branch", "worktree"):
        beside |= F.contains(plain, F.concat(s, F.lit(f" {kind}"))) | F.contains(plain, F.concat(F.lit(f"{kind} "), s))
    digest = "[0-9a-f]{6,40}"
    commit = s.rlike(f"^commit [`'\"]*{digest}[`'\"]*$") | (s.rlike(f"^{digest}$") & F.lower(context).rlike("commit|rollback|revision"))
    numbered = s.rlike(r"^(build|benchmark run|test run|deployment)[\s#:-]*[0-9a-f._-]*[0-9a-f._]$")
    ids = s.rlike(r"^(request|response|run|build|deployment|session) id[\s:#=]*[a-z0-9._/-]{4,}$")
    return beside | commit | numbered | ids


def category_summary(kind: Column, summary: Column) -> Column:
    """Whether an entity of a loose kind is described as a category."""
    return kind.isin("domain_entity", "other") & F.lower(summary).rlike("|".join(CATEGORY_PHRASES))


def transient_summary(surface: Column, summary: Column) -> Column:
    """Whether a summary describes something that passes, such as a branch named by the surface."""
    s, text = F.lower(blank_trimmed(surface)), F.lower(summary)
    named = F.contains(text, F.concat(F.lit("branch named "), s)) | F.contains(text, F.concat(F.lit("worktree named "), s))
    return text.rlike("|".join(PASSING_PHRASES)) | named


def admitted(mentions: DataFrame) -> DataFrame:
    """mentions (surface, context, kind, summary, known, recurs) with gate: what turns one away, or `open`.
    known: whether there is context of other mentions; recurs: whether it is only admitted if it recurs.
    `recurrence` leaves a mention unresolved until it comes again."""
    gate = (
        F.when(generic_surface(F.col("surface")), "generic")
        .when(F.coalesce(transient_surface(F.col("surface"), F.col("context")), F.lit(False)), "transient")
        .when(F.col("kind").isNull() | F.col("kind").isin("", "unknown") | (blank_trimmed(F.coalesce("summary", F.lit(""))) == ""), "incomplete")
        .when(transient_summary(F.col("surface"), F.col("summary")), "transient")
        .when(category_summary(F.col("kind"), F.col("summary")), "category")
        .when(~F.col("known") & (F.col("recurs") | F.col("kind").isin(RECURRING_KINDS)), "recurrence")
        .otherwise("open")
    )
    return mentions.withColumn("gate", gate)


# -- mentions ---------------------------------------------------------------------------------


def mentions_by_surface(mentions: DataFrame, surfaces: DataFrame) -> DataFrame:
    """mentions (text, ...) whose text is one of surfaces (surface), letters' case and blanks around aside."""
    s = surfaces.select(normalize_surface(F.col("surface")).alias("_key")).distinct()
    return mentions.withColumn("_key", normalize_surface(F.col("text"))).join(s, "_key", "left_semi").drop("_key")


def contains_surface(title: Column, content: Column, surface: Column) -> Column:
    s = normalize_surface(surface)
    return (s != "") & (F.contains(F.lower(title), s) | F.contains(F.lower(content), s))


def context_terms(mentions: DataFrame) -> DataFrame:
    """mentions (text, field, start, end, title, content) with query: at most 16 distinct terms of the
    mention, of the title if it is in the content, and of 96 characters on either side. Offsets are bytes."""
    field = F.when(F.col("field") == "title", F.col("title")).otherwise(F.col("content"))
    raw = field.cast("binary")
    before, after = F.substring(raw, F.lit(1), F.col("start").cast("int")).cast("string"), F.substring(raw, F.col("end").cast("int") + 1, F.octet_length(field)).cast("string")
    near = F.concat(F.right(before, F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(after, F.lit(CONTEXT_CHARS)))
    of_title = F.when(F.col("field") == "title", F.array().cast("array<string>")).otherwise(lexical_terms(F.col("title")))
    terms = F.array_distinct(F.concat(lexical_terms(F.col("text")), of_title, lexical_terms(near)))
    return mentions.withColumn("query", F.array_join(F.slice(terms, 1, CONTEXT_TERMS), " "))


def resolved_in_waves(mentions: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """(mention, entity, wave): mentions (mention, surface) against entities (key, entity).

    In a wave all open mentions look at the same snapshot: those that it knows are resolved; of those
    that it doesn't, the first of each key makes an entity, named by itself, and the others wait for the
    next wave, which sees it. So a wave is one join, however many mentions there are.
    """
    left = mentions.select("mention", normalized_surface(F.col("surface")).alias("key")).where("key <> ''")
    done, snapshot = None, known.select("key", "entity")
    for wave in range(1, most + 1):
        hits = left.join(snapshot, "key").select("mention", "entity")
        rest = left.join(snapshot.select("key"), "key", "left_anti")
        made = rest.groupBy("key").agg(F.min("mention").alias("mention")).withColumn("entity", F.col("mention"))
        now = cut(hits.union(made.select("mention", "entity")).withColumn("wave", F.lit(wave)), "wave")
        snapshot = cut(snapshot.union(made.select("key", F.col("entity").cast(dict(known.dtypes)["entity"]))), "snapshot")
        done = now if done is None else done.union(now)
        left = cut(left.join(now.select("mention"), "mention", "left_anti"), "open")
        if left.isEmpty():
            break
    return done


def ordered_pairs(pairs: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(left_id, right_id, score, place): the first `most` pairs by score, then the left one's name (id,
    name) and ids."""
    named = pairs.join(names.select(F.col("id").alias("left_id"), F.col("name").alias("_name")), "left_id")
    first = named.orderBy(F.desc("score"), "_name", "left_id", "right_id").limit(most)
    order = Window.orderBy(F.desc("score"), "_name", "left_id", "right_id")  # over `most` rows
    return first.withColumn("place", F.row_number().over(order)).select("left_id", "right_id", "score", "place")


def reconciled(entities: DataFrame, aliases: DataFrame, edges: DataFrame, same: Callable[[DataFrame], DataFrame], rounds: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aliases, edges, tombstones) after rounds of pairing entities (id, name, kind), asking `same` which
    pairs (left_id, right_id, score) are one, and merging those into the least id; it ends when a round
    finds none."""
    gone = None
    for _ in range(rounds):
        yes = same(block_pairs(entities)).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
        merges = cut(components(yes).where("node <> root").select(F.col("node").alias("id"), F.col("root").alias("into")), "merges")
        if merges.isEmpty():
            break
        aliases, edges, dead = merged(aliases, edges, merges)
        aliases, edges = cut(aliases, "aliases"), cut(edges, "edges")
        entities = cut(entities.join(merges.select("id"), "id", "left_anti"), "entities")
        gone = dead if gone is None else gone.union(dead)
    return aliases, edges, gone if gone is not None else aliases.sparkSession.createDataFrame([], f"id {dict(entities.dtypes)['id']}, replacement_id {dict(entities.dtypes)['id']}")
