"""Rules of candidates and of answers on pairs, case by case, and rounds of evidence."""

import json

import pytest
from pyspark.sql import functions as F
from turnstone.operators import extraction as x
from turnstone.operators.admission import admitted
from turnstone.operators.classify import classified, judged

GOOD = {"authority": "direct", "category": "fact", "type": "project", "status": "current", "title": "A title", "content": "The engine uses tables", "quote": "said", "role": "user", "turn": "as I said", "authority_source": "", "grounding_source": ""}
CASES = [
    ({}, ""),
    ({"authority": " Direct "}, ""),
    ({"authority": "hearsay"}, "authority"),
    ({"category": None}, "category"),
    ({"type": "mood"}, "type"),
    ({"title": " \t"}, "empty"),
    ({"turn": None, "role": None}, "no source"),
    ({"role": "assistant"}, "not a user turn"),
    ({"quote": "sayd"}, "not verbatim"),
    ({"quote": " "}, "not verbatim"),
    ({"quote": " said\n"}, ""),
    ({"status": "past"}, "status"),
    ({"authority_source": "n1"}, "authority by assistant"),
    ({"authority": "correction", "authority_source": "n1"}, "authority by assistant"),
    ({"authority": "adoption"}, "adoption without source"),
    ({"authority": "adoption", "authority_source": "n1"}, ""),
    # what is to be kept
    ({"authority": "retention", "quote": "Remember that!"}, "retention without source"),
    ({"authority": "retention", "quote": "Remember that!", "authority_source": "n1"}, ""),
    ({"authority": "retention", "quote": "remember that plan of ours"}, "retention without source"),
    ({"authority": "retention", "quote": "remember that I prefer tea"}, ""),
    ({"authority": "retention", "quote": "remember this: tea at five"}, ""),
    ({"authority": "retention", "quote": "Remember the plan we discussed"}, "retention without source"),
    ({"authority": "retention", "quote": "Remember the milk"}, ""),
    # pointing
    ({"quote": "Sounds good."}, "vague"),
    ({"quote": "Sounds good.", "grounding_source": "n1"}, ""),
    ({"quote": "Sounds good.", "content": "It is good"}, ""),
    ({"quote": "yes, use those", "content": "The engine uses large tables of pairs"}, "vague"),
    ({"quote": "yes, use those", "content": "The engine uses tables"}, ""),
    ({"quote": "yes, use those big tables of ours in the new engine", "content": "The engine uses tables of pairs"}, ""),
    # questions
    ({"quote": "Does it use tables?"}, "question"),
    ({"quote": "I like it. Does it use tables?"}, ""),
    ({"quote": "Must it use tables?"}, ""),
    ({"quote": "It uses tables, right?"}, ""),
    ({"quote": "It uses tables, right?", "category": "preference"}, "question"),
    ({"quote": "Does it use tables, right?"}, "question"),
    # reports of work
    ({"title": "Step 5"}, ""),
    ({"title": "Step 5 is done", "content": "The engine uses tables"}, "receipt"),
    ({"title": "Phases up to number 7"}, "receipt"),
    ({"title": "Step one two three four 5 is done"}, ""),
    ({"content": "The tests passed"}, "receipt"),
    ({"content": "The worktree uses pairs, merged"}, ""),
    ({"title": "The branch is merged", "content": "It lives in the store"}, ""),
]


@pytest.fixture(scope="module")
def problems(spark):
    rows = [(i, *({**GOOD, "turn": f"so {c.get('quote', 'said')} I" if c.get("quote", "said") != "sayd" else "as I said", **c}.values())) for i, (c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{k} string" for k in GOOD))
    return {r.i: r.problem for r in df.select("i", x.candidate_problem().alias("problem")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_candidate(problems, i):
    assert problems[i] == CASES[i][1], CASES[i]


def test_the_first_of_an_anchor_is_kept(spark):
    turns = spark.createDataFrame([("e", "t", "user", "I use tea")], "episode string, turn_id string, role string, content string")
    one = {"episode": "e", "turn_id": "t", "authority": "direct", "category": "fact", "type": "other", "status": "current", "title": "Tea", "quote": "tea", "authority_source": "", "grounding_source": ""}
    rows = [{**one, "place": p, "content": c, "semantic_key": k} for p, c, k in ((2, "Tea again", ""), (1, "Tea", ""), (3, "Tea", "other"), (0, " ", ""))]
    found = spark.createDataFrame(rows)
    yes, no = x.validated(found, turns)
    assert sorted(r.place for r in yes.collect()) == [1, 3] and {(r.place, r.problem) for r in no.collect()} == {(2, "duplicate"), (0, "empty")}


def test_gates(spark):
    rows = [
        ("Widget", "", "product", "A thing", True, False, "open"), (" The Server\t", "", "product", "A thing", True, False, "generic"), ("fix-1", "", "product", "The branch named FIX-1 of it", True, False, "transient"),
        ("run 7", "", "product", "Some benchmark run", True, False, "transient"), ("Widget", "", "other", "A general concept", True, False, "category"), ("f", "", "code_symbol", "A function", False, False, "recurrence"),
        ("f", "", "code_symbol", "A function", True, False, "open"), ("Widget", "", "product", "A thing", False, True, "recurrence"), ("Widget", "", "product", "\n", False, True, "incomplete"),
    ]
    df = spark.createDataFrame(rows, "surface string, context string, kind string, summary string, known boolean, recurs boolean, want string")
    assert all(r.gate == r.want for r in admitted(df).collect())


ANSWERS = [
    ('{"relation": "topical", "direction": "none", "evidence": [{"side": "a", "quote": " one "}, {"side": "b", "quote": "two"}]}', ""),
    ('{"relation": "none", "direction": "a_to_b", "evidence": []}', ""),
    (None, "not an object"), ("no", "not an object"), ("[1]", "not an object"), ("{}", "missing relation"), ('{"relation": "friend"}', "unknown relation"), ('{"relation": "none"}', "missing direction"),
    ('{"relation": "none", "direction": "up"}', "unknown direction"), ('{"relation": "causal", "direction": "none"}', "no direction"), ('{"relation": "none", "direction": "none"}', "evidence is no array"),
    ('{"relation": "none", "direction": "none", "evidence": [{"side": "a", "quote": "one"}]}', "none has evidence"), ('{"relation": "topical", "direction": "none", "evidence": []}', "not two quotes"),
    ('{"relation": "topical", "direction": "none", "evidence": [{"side": "a", "quote": "one"}, {"side": "c", "quote": "two"}]}', "unknown side"),
    ('{"relation": "topical", "direction": "none", "evidence": [{"side": "a", "quote": "one"}, {"side": "a", "quote": "one"}]}', "two quotes of a side"),
    ('{"relation": "topical", "direction": "none", "evidence": [{"side": "a", "quote": "two"}, {"side": "b", "quote": "two"}]}', "not verbatim"),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, i + 1, "has one", "has two", a) for i, (a, _) in enumerate(ANSWERS)] + [(50, 50, "has one", "has two", ANSWERS[0][0])], "a int, b int, a_text string, b_text string, answer string")
    got = {r.a: r for r in judged(df).collect()}
    assert [got[i].problem for i in range(len(ANSWERS))] == [p for _, p in ANSWERS] and got[50].problem == "a pair of one"
    assert (got[0].relation, got[0].direction, got[0].a_quote, got[0].b_quote) == ("topical", "undirected", "one", "two") and (got[1].direction, got[1].a_quote) == ("none", None)


def test_only_what_failed_is_asked_again(spark):
    pairs = spark.createDataFrame([(i, i + 10, "one", "two") for i in range(4)], "a long, b long, a_text string, b_text string")
    asked = []

    def model(df):
        rows = df.collect()
        asked.append({r.a: list(r.errors) for r in rows})
        good = json.dumps({"relation": "topical", "direction": "none", "evidence": [{"side": "a", "quote": "one"}, {"side": "b", "quote": "two"}]})
        out = [(r.a, r.b, good if r["round"] > r.a else "{}") for r in rows if r.a != 3 or r["round"] != 2]
        return spark.createDataFrame(out, "a long, b long, answer string")

    got = {r.a: (r.rounds, r.problem) for r in classified(pairs, model).collect()}
    assert got == {0: (1, ""), 1: (2, ""), 2: (3, ""), 3: (3, "missing relation")}
    assert asked == [{0: [], 1: [], 2: [], 3: []}, {1: ["missing relation"], 2: ["missing relation"], 3: ["missing relation"]}, {2: ["missing relation"] * 2, 3: ["missing relation", "not an object"]}]


def test_requests_are_bounded_and_entered_once(spark):
    turns = spark.createDataFrame([("e", f"t{i}", i, "user", f"word{i} text") for i in range(3)], "episode string, turn_id string, position int, role string, content string")
    seen = []

    def ask(df, evidence):
        seen.append(evidence.count())
        return spark.createDataFrame([("e", "search", "word2", 0), ("e", "turn", "t1", 1), ("e", "turn", "gone", 2), ("e", "walk", "x", 3), ("e", "turn", f"t{len(seen)}", 4), ("e", "turn", "t1", 9)], "episode string, kind string, value string, place int")

    def make(df, evidence):
        return df.limit(0).select("episode", F.lit(0).alias("place"), "turn_id", *(F.lit("").alias(c) for c in ("authority", "category", "type", "status", "title", "quote", "authority_source", "grounding_source", "semantic_key")), F.lit("").alias("content"))

    _, _, ledger = x.extracted(turns, ask, make, turns.select("turn_id", "role", "content"), rounds=3)
    got = {(r.kind, r.value): (r["round"], r.outcome, r.found) for r in ledger.collect()}
    assert got == {("search", "word2"): (1, "answered", 1), ("turn", "t1"): (1, "answered", 1), ("turn", "gone"): (1, "nothing", 0), ("walk", "x"): (1, "unknown kind", 0), ("turn", "t2"): (2, "refused", 0), ("turn", "t3"): (3, "refused", 0)}
    assert seen == [0, 2, 2]
