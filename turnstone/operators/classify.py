"""Relations of pairs of statements: a model's answers checked against their contract, and asked for again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_trimmed
from ..session import cut

# What a pair may be to each other, which of these have a direction, and the directions.
RELATIONS = ["none", "topical", "factual", "causal", "recurrent", "duplicate_of", "supersedes"]
DIRECTED = ["factual", "causal", "supersedes"]
DIRECTIONS = ["none", "undirected", "a_to_b", "b_to_a"]
ANSWER = "relation string, direction string, evidence array<struct<side:string,quote:string>>"


def answer_problem(answer: Column, a_text: Column, b_text: Column, trimmed: Callable[[Column], Column] = blank_trimmed) -> Column:
    """What is wrong with an answer (a struct of ANSWER, null if it wasn't an object); '' if nothing."""
    relation, direction, evidence = answer["relation"], answer["direction"], answer["evidence"]
    none = relation == "none"
    unlike = lambda x, values: ~F.coalesce(x.isin(values), F.lit(False))
    sides = F.transform(evidence, lambda e: e["side"])
    said = lambda e: trimmed(F.coalesce(e["quote"], F.lit("")))
    text = lambda e: F.when(e["side"] == "a", a_text).otherwise(b_text)
    return (
        F.when(answer.isNull(), "not an object")
        .when(relation.isNull(), "missing relation")
        .when(unlike(relation, RELATIONS), "unknown relation")
        .when(direction.isNull(), "missing direction")
        .when(unlike(direction, DIRECTIONS), "unknown direction")
        .when(relation.isin(DIRECTED) & ~direction.isin("a_to_b", "b_to_a"), "no direction")
        .when(evidence.isNull(), "evidence is no array")
        .when(none & (F.size(evidence) > 0), "none has evidence")
        .when(~none & (F.size(evidence) != 2), "not two quotes")
        .when(F.exists(evidence, lambda e: unlike(e["side"], ["a", "b"])), "unknown side")
        .when(F.size(F.array_distinct(sides)) < F.size(sides), "two quotes of a side")
        .when(F.exists(evidence, lambda e: (said(e) == "") | ~F.contains(text(e), said(e))), "not verbatim")
        .otherwise("")
    )


def judged(answers: DataFrame, trimmed: Callable[[Column], Column] = blank_trimmed) -> DataFrame:
    """answers (a, b, a_text, b_text, answer) with relation, direction, a_quote, b_quote and problem. answer:
    JSON; relations without a direction get `undirected`, none gets `none`; quotes are trimmed."""
    rows = answers.withColumn("_x", F.from_json("answer", ANSWER, {"mode": "PERMISSIVE"}))
    rows = rows.withColumn("_x", F.when(F.get_json_object("answer", "$").startswith("{"), F.col("_x")))
    rows = rows.withColumn("problem", F.when(F.col("a") == F.col("b"), "a pair of one").otherwise(answer_problem(F.col("_x"), F.col("a_text"), F.col("b_text"), trimmed)))
    ok = F.col("problem") == ""
    relation = F.col("_x.relation")
    direction = F.when(relation == "none", "none").when(~relation.isin(DIRECTED), "undirected").otherwise(F.col("_x.direction"))
    quote = lambda side: F.try_element_at(F.transform(F.filter("_x.evidence", lambda e: e["side"] == side), lambda e: trimmed(e["quote"])), F.lit(1))
    kept = {"relation": relation, "direction": direction, "a_quote": quote("a"), "b_quote": quote("b")}
    return rows.select(*answers.columns, *(F.when(ok, c).alias(n) for n, c in kept.items()), "problem")


def classified(pairs: DataFrame, model: Callable[[DataFrame], DataFrame], rounds: int = 3, trimmed: Callable[[Column], Column] = blank_trimmed) -> DataFrame:
    """(a, b, relation, direction, a_quote, b_quote, rounds, problem) of pairs (a, b, a_text, b_text), a < b.

    The model is given pairs with round and errors (what was wrong in the rounds before) and gives (a,
    b, answer). Only what failed is asked again; after the last round it is rejected with its problem,
    as is a pair that the model passed over.
    """
    pairs = cut(pairs.select("a", "b", "a_text", "b_text").dropDuplicates(["a", "b"]), "pairs")
    open_, done = pairs.withColumn("errors", F.array().cast("array<string>")), None
    for k in range(1, rounds + 1):
        answers = model(open_.withColumn("round", F.lit(k))).select("a", "b", "answer").dropDuplicates(["a", "b"])
        got = cut(judged(open_.join(answers, ["a", "b"], "left"), trimmed), "judged")
        last = got if k == rounds else got.where("problem = ''")
        rows = last.select("a", "b", "relation", "direction", "a_quote", "b_quote", F.lit(k).alias("rounds"), "problem")
        done = rows if done is None else done.union(rows)
        failed = got.where("problem <> ''")
        if k == rounds or failed.isEmpty():
            break
        open_ = failed.select("a", "b", "a_text", "b_text", F.array_append("errors", F.col("problem")).alias("errors"))
    return done
