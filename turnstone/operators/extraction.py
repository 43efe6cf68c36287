"""Statements out of episodes: rounds of evidence for a model, and rules that its candidates must keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_trimmed, lexical_terms
from ..session import cut
from .lexical import best_of_batch

# What a candidate may be.
AUTHORITIES = ["direct", "correction", "adoption", "retention"]
CATEGORIES = ["fact", "preference", "decision", "instruction", "relationship", "constraint", "correction", "commitment"]
TYPES = ["identity", "education", "employment", "location", "possession", "health", "finance", "schedule", "communication", "project", "process", "product", "relationship", "other"]
STATUSES = ["current", "future", "historical"]
# Steps of work, words of their end, words of progress, words of what lasts.
COUNTED = ["prompt", "prompts", "phase", "phases", "step", "steps"]
PASSING = [*COUNTED, "test run", "tests", "commit", "push", "merge", "verification", "cleanup", "worktree", "branch", "milestone"]
ENDED = ["completed", "complete", "done", "finished", "passed", "pushed", "merged", "committed", "verified", "reached", "clean"]
PROGRESS = ["completed", "complete", "done", "finished", "passed", "reached", "checkpoint", "milestone", "progress", "through", "up to"]
LASTING = [
    "uses", "owns", "references", "stores", "requires", "configured", "now uses", "moved to", "lives in", "returns", "sends", "persists",
    "wired through", "routes through", "supports", "rejects", "accepts",
]
# Asking to keep what was said before, words that say it again, pointers to what was said.
KEEP_THAT = ["remember that", "remember this", "remember it", "retain that", "retain this"]
SAID_BEFORE = ["discussed", "talked about", "mentioned", "earlier", "before"]
PREDICATES = [
    "am", "is", "are", "was", "were", "use", "uses", "prefer", "prefers", "want", "wants", "need", "needs", "should", "must", "will", "have", "has",
    "own", "owns", "run", "runs", "store", "stores", "require", "requires",
]
POINTERS = ["that", "this", "it", "them", "those", "these"]
AGREED = [
    "sounds good", "that works", "this works", "good rule", "do that", "do this", "do it", "add that", "add this", "change that", "change this",
    "finish that", "finish this", "finish it", "get it done", "get that done", "alright do that then", "alright that works", "ok done", "okay done",
]
FILLERS = [
    "a", "an", "and", "the", "to", "of", "for", "in", "on", "with", "i", "we", "you", "that", "this", "it", "them", "those", "these", "do", "then",
    "alright", "ok", "okay", "please", "just", "good", "sounds",
]
# What makes a question say something, how questions begin, what turns a saying into one.
ASSERTING = ["have to", "has to", "must", "will", "i prefer", "i don't want", "i do not want"]
ASKING = ["what", "why", "how", "when", "where", "who", "can", "could", "would", "should", "is", "are", "am", "do", "does", "did", "will", "have", "has"]
TAGS = ["right", "correct", "is it", "isn't it", "are they", "aren't they", "don't they", "doesn't it", "yeah", "no"]

#: Turns of an episode that a model sees, requests that an episode has, rounds, turns that a search gives.
MOST_TURNS, MOST_REQUESTS, MOST_ROUNDS, SEARCH_TURNS = 64, 4, 4, 5


def plain(text: Column) -> Column:
    """Lower case, letters, numbers and apostrophes, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}']+", " "))


def _says(text: Column, words: list[str]) -> Column:
    """Whether plain text has one of the words or phrases."""
    return F.concat(F.lit(" "), text, F.lit(" ")).rlike(" (" + "|".join(words) + ") ")


def informative(text: Column) -> Column:
    """Words of a plain text that aren't fillers."""
    return F.size(F.filter(F.split(text, " "), lambda w: (w != "") & ~w.isin(FILLERS)))


def label(value: Column) -> Column:
    return F.replace(F.lower(blank_trimmed(value)), F.lit("-"), F.lit("_"))


def receipt(title: Column, content: Column) -> Column:
    """Whether a candidate reports work instead of what holds: counted steps with progress, or a step
    that passes and its end, without a word of what lasts."""
    both = F.concat_ws(" ", plain(title), plain(content))
    padded = F.concat(F.lit(" "), both, F.lit(" "))
    counted = padded.rlike(" (" + "|".join(COUNTED) + ")( [^ ]+){0,3} [0-9]") & _says(both, PROGRESS)
    return counted | (_says(both, PASSING) & _says(both, ENDED) & ~_says(plain(content), LASTING))


def points_back(quote: Column) -> Column:
    """Whether a request to remember names only what was said before."""
    p = plain(quote)
    rest = F.regexp_replace(p, "^remember (that|this) ", "")
    return (
        F.when(p.isin(KEEP_THAT), True)
        .when(p.rlike("^remember (that|this) "), ~F.contains(quote, F.lit(":")) & ~_says(rest, PREDICATES))
        .otherwise(p.rlike("^remember the ") & p.rlike(" (" + "|".join(SAID_BEFORE) + ")"))
    )


def too_vague(quote: Column, content: Column) -> Column:
    """Whether a quote that agrees or points can't carry as much as the content says."""
    p, told = plain(quote), informative(plain(content))
    pointing = _says(p, POINTERS) & (F.size(F.split(p, " ")) <= 8) & (informative(p) <= 2) & (told >= 5)
    return F.when(p.isin(AGREED), told >= 3).otherwise(pointing)


def only_asks(quote: Column, category: Column) -> Column:
    """Whether a quote is a question that says nothing."""
    q = blank_trimmed(quote)
    p = plain(q)
    tag = ~p.rlike("^(" + "|".join(ASKING) + ") ") & p.rlike(" (" + "|".join(TAGS) + ")$")
    return q.endswith("?") & ~q.rlike(r"[.!] ") & ~_says(p, ASSERTING) & ~(category.isin("fact", "correction") & tag)


def candidate_problem() -> Column:
    """What is wrong with an extracted candidate (authority, category, type, status, title, content, quote,
    role, turn, authority_source, grounding_source); '' if nothing. role and turn: of the turn it names."""
    text = lambda name: blank_trimmed(F.coalesce(F.col(name), F.lit("")))
    quote, category, authority = text("quote"), label(F.col("category")), label(F.col("authority"))
    by, ground = text("authority_source") != "", text("grounding_source") != ""
    one_of = lambda value, values: ~F.coalesce(value.isin(values), F.lit(False))
    return (
        F.when(one_of(authority, AUTHORITIES), "authority")
        .when(one_of(category, CATEGORIES), "category")
        .when(one_of(label(F.col("type")), TYPES), "type")
        .when((text("title") == "") | (text("content") == ""), "empty")
        .when(F.col("turn").isNull(), "no source")
        .when(F.col("role") != "user", "not a user turn")
        .when((quote == "") | ~F.contains("turn", quote), "not verbatim")
        .when(one_of(label(F.col("status")), STATUSES), "status")
        .when(authority.isin("direct", "correction") & by, "authority by assistant")
        .when((authority == "adoption") & ~by, "adoption without source")
        .when((authority == "retention") & ~by & points_back(quote), "retention without source")
        .when(~by & ~ground & too_vague(quote, text("content")), "vague")
        .when(only_asks(quote, category), "question")
        .when(receipt(text("title"), text("content")), "receipt")
        .otherwise("")
    )


def validated(found: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with problem) of candidates (episode, place, turn_id, ..., semantic_key) of
    turns (episode, turn_id, role, content). Of good ones with one anchor (turn, quote, sources, key)
    the first is accepted, the others are duplicates."""
    said = turns.select("episode", "turn_id", "role", F.col("content").alias("turn"))
    judged = found.join(said, ["episode", "turn_id"], "left").withColumn("problem", candidate_problem())
    anchor = ["episode", "turn_id", *(blank_trimmed(F.coalesce(F.col(c), F.lit(""))) for c in ("quote", "authority_source", "grounding_source", "semantic_key"))]
    again = F.row_number().over(Window.partitionBy(*anchor, F.col("problem") == "").orderBy("place")) > 1
    judged = judged.withColumn("problem", F.when((F.col("problem") == "") & again, "duplicate").otherwise(F.col("problem")))
    return judged.where("problem = ''").drop("problem"), judged.where("problem <> ''")


def answered(requests: DataFrame, archive: DataFrame) -> DataFrame:
    """(episode, kind, value, turn_id, role, content): what requests (episode, kind, value) find in an
    archive of turns (turn_id, role, content): `turn` the one named, `search` the best SEARCH_TURNS for a
    query. All searches of a round are one batch."""
    own = ["episode", "kind", "value"]
    named = requests.where("kind = 'turn'").join(archive, F.col("value") == F.col("turn_id")).select(*own, "turn_id", "role", "content")
    asked = requests.where("kind = 'search'").select("value").distinct()
    terms = asked.select(F.col("value").alias("query_id"), lexical_terms(F.col("value")).alias("terms"))
    best = best_of_batch(archive, terms, "turn_id", "content", SEARCH_TURNS).select(F.col("query_id").alias("value"), "turn_id").join(archive, "turn_id")
    return named.union(requests.where("kind = 'search'").join(best, "value").select(*own, "turn_id", "role", "content"))


def extracted(
    turns: DataFrame, ask: Callable[[DataFrame, DataFrame], DataFrame], make: Callable[[DataFrame, DataFrame], DataFrame], archive: DataFrame, most_turns: int | None = MOST_TURNS, most_requests: int = MOST_REQUESTS, rounds: int = MOST_ROUNDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, ledger) of a model over episodes' turns (episode, turn_id, position, role, content).

    In a round the model is given the first most_turns turns (None: all) of each episode that is still asking and
    the evidence so far, and `ask` gives requests (episode, kind, value, place). What an episode has
    asked before is left out; beyond most_requests a request is refused. Rounds end when nothing new
    is asked. Then `make` gives candidates, which are validated. ledger: (episode, round, kind, value,
    outcome, found): answered, nothing, refused or unknown kind.
    """
    place = F.row_number().over(Window.partitionBy("episode").orderBy("position"))
    seen = cut(turns if most_turns is None else turns.withColumn("_n", place).where(F.col("_n") <= most_turns).drop("_n"), "turns")
    id_ = dict(turns.dtypes)
    spark = turns.sparkSession
    evidence = spark.createDataFrame([], f"episode {id_['episode']}, kind string, value string, turn_id {id_['turn_id']}, role string, content string")
    ledger = spark.createDataFrame([], f"episode {id_['episode']}, round int, kind string, value string, outcome string, found long")
    asking = seen
    for turn in range(1, rounds + 1):
        given = ask(asking, evidence).groupBy("episode", "kind", "value").agg(F.min("place").alias("place"))
        new = given.join(ledger, ["episode", "kind", "value"], "left_anti")
        used = ledger.where("outcome <> 'refused'").groupBy("episode").agg(F.count("*").alias("_used"))
        nth = F.row_number().over(Window.partitionBy("episode").orderBy("place", "kind", "value"))
        new = cut(new.join(used, "episode", "left").withColumn("_k", nth + F.coalesce("_used", F.lit(0))), "requests")
        if new.isEmpty():
            break
        granted = new.where(F.col("_k") <= most_requests)
        got = cut(answered(granted.select("episode", "kind", "value"), archive), "answers")
        counts = got.groupBy("episode", "kind", "value").agg(F.count("*").alias("found"))
        outcome = F.when(F.col("_k") > most_requests, "refused").when(~F.col("kind").isin("turn", "search"), "unknown kind").when(F.col("found").isNull(), "nothing").otherwise("answered")
        entries = new.join(counts, ["episode", "kind", "value"], "left").select("episode", F.lit(turn).alias("round"), "kind", "value", outcome.alias("outcome"), F.coalesce("found", F.lit(0)).alias("found"))
        ledger, evidence = cut(ledger.union(entries), "ledger"), cut(evidence.union(got), "evidence")
        asking = seen.join(new.select("episode").distinct(), "episode", "left_semi")
    accepted, rejected = validated(cut(make(seen, evidence), "candidates"), turns)
    return accepted, rejected, ledger
