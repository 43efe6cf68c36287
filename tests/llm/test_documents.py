"""Operators 4, 5, 6, 7 and 9 against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from turnstone.llm.hyper_language import gram_counts, held_out, language_report, learn, letter_vector, predict
from turnstone.llm.line_dedup import drop_common_lines, line_report
from turnstone.llm.ngram_join import is_link, linked, ngram_join, prefix_size, shingle_sets, suffix_bound
from turnstone.llm.pfair_mix import mix_sources, schedule
from turnstone.llm.pii import all_spans, base_spans, find_pii, pii_report

from .conftest import DOCS, clashing, words

# -- 4 ------------------------------------------------------------------------


def brute_schedule(blocks, weights):
    """All slots by hand: the even flow step by step gives each block's window, then every slot looks
    through all blocks."""
    left, exact, time, windows = {s: Fraction(n) for s, n in blocks.items()}, {s: Fraction(w) for s, w in weights.items()}, Fraction(0), {s: [Fraction(0)] for s in blocks}
    while left:
        rates = {s: exact[s] / sum(exact[x] for x in left) for s in left}
        step = min((left[s] - (-(-left[s] // 1) - 1)) / rates[s] for s in left)  # until some block is through
        time += step
        for s in list(left):
            before = left[s]
            left[s] -= rates[s] * step
            if left[s].denominator == 1 and before > left[s]:
                windows[s].append(time)
            if not left[s]:
                del left[s]
    waiting = {(s, k): (w[k] // 1, -(-w[k + 1] // 1)) for s, w in windows.items() for k in range(blocks[s])}
    out = []
    for t in range(sum(blocks.values())):
        s, k = min((x for x in waiting if waiting[x][0] <= t), key=lambda x: (waiting[x][1], x))
        del waiting[s, k]
        out.append((s, k))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_schedule_is_that_by_hand(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.choice([1, 2, 5, 30.5, 300, 1 / 3]) for i in range(rng.randint(1, 6))}
    blocks = {s: rng.randint(1, 40) for s in weights}
    assert list(schedule(blocks, weights)) == brute_schedule(blocks, weights)


def test_very_many_sources():
    rng = random.Random(2)
    blocks = {f"s{i}": rng.randint(1, 60) for i in range(5_000)}
    began = time.time()
    order = list(schedule(blocks, {s: n**0.5 for s, n in blocks.items()}))
    assert time.time() - began < 10 and len(set(order)) == len(order) == sum(blocks.values())


def test_blocks_grow_with_the_table(spark, docs, texts, monkeypatch):
    from turnstone.llm import pfair_mix as module

    monkeypatch.setattr(module, "MOST_BLOCKS", 10)
    monkeypatch.setattr(module, "BUCKET_DOCS", 4)
    rows = mix_sources(docs, block_docs=1).collect()
    assert sorted(r.mix_position for r in rows) == list(range(len(texts))) and max(r.mix_slot for r in rows) <= 10 + 3


@pytest.mark.parametrize("seed", range(8))
def test_schedule_keeps_to_the_weights_given(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.choice([1 / 3, 2 / 3, 1e-6, 0.5, 7**0.5, 40]) for i in range(rng.choice([2, 5, 40]))}
    blocks = {s: rng.randint(1, 120) for s in weights}
    order = list(schedule(blocks, weights))
    assert sorted(order) == [(s, k) for s in sorted(blocks) for k in range(blocks[s])]
    flow, had, exact = dict.fromkeys(blocks, Fraction(0)), Counter(), {s: Fraction(w) for s, w in weights.items()}
    for s, k in order:
        assert k == had[s]
        had[s] += 1
        time = Fraction(1)
        while time:  # one slot of the even flow
            left = [x for x in flow if flow[x] < blocks[x]]
            total = sum(exact[x] for x in left)
            step = min(time, *((blocks[x] - flow[x]) * total / exact[x] for x in left), time)
            for x in left:
                flow[x] += step * exact[x] / total
            time -= step
        assert all(abs(had[x] - flow[x]) < 1 for x in flow)


def test_mix_keeps_to_the_weights_given(spark):
    n = {"a": 2_000, **{f"s{i}": 40 for i in range(50)}}
    df = spark.createDataFrame([(i, "", s) for i, s in enumerate(s for s, m in n.items() for _ in range(m))], "doc_id long, text string, source string")
    weights = {s: 0.5 if s == "a" else 0.01 for s in n}
    slots = {r.mix_slot: r.source for r in mix_sources(df, weights, block_docs=1).where("mix_slot < 4000").collect()}
    assert len(slots) == 4_000
    had = 0
    for t in range(4_000):
        had += slots[t] == "a"
        assert abs(had - (t + 1) / 2) < 1
    zero = mix_sources(df, {s: float(s == "a") for s in n}, block_docs=1).where("source = 'a'").agg(F.max("mix_slot")).first()[0]
    assert zero == 1_999


def test_mix_places_every_document_once(spark, docs, texts, empty_docs):
    rows = mix_sources(clashing(docs), block_docs=3).orderBy("mix_position").collect()
    assert [r.mix_position for r in rows] == list(range(len(texts))) and {r.doc_id for r in rows} == set(range(len(texts)))
    by_slot = defaultdict(list)
    for r in rows:
        by_slot[r.mix_slot].append((r.source or "", r.mix_block))
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(set(x)) == 1 for x in by_slot.values())
    assert mix_sources(empty_docs).count() == 0
    twice = spark.createDataFrame([(1, "x", "a"), (1, "x", "a"), (None, None, None)], "doc_id long, text string, source string")
    assert sorted(r.mix_position for r in mix_sources(twice).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        mix_sources(docs, {"a": 1.0})


# -- 5 ------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    checks = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), lambda s: 8 <= len(digits(s)) <= 15]
    return [[m.span() for m in re.finditer(p, text) if ok(m[0])] for p, ok in zip(PATTERNS, checks, strict=True)]


def test_base_spans():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choices("ab.@+-1234567890 ()_%é\n", k=rng.randrange(5, 60)))
        assert base_spans(text) == brute(text)
    assert base_spans("1" * 200_000 + " " + "a" * 200_000) == [[], [], [], []]  # no quadratic scans
    assert base_spans("4111 1111-1111 1111 1.2.3.4.5.6.7.8 +49 (30) 1234567")[0] == []


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail joe.smith (at) mail (dot) example (dot) com now", "email", "joe.smith (at) mail (dot) example (dot) com"),
        ("jane at example dot com", "email", "jane at example dot com"),
        ("joe[at]mail[dot]example.com", "email", "joe[at]mail[dot]example.com"),
        ("x jоe@exаmple.com", "email", "jоe@exаmple.com"),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus one two three four five six seven eight nine", "phone", "plus one two three four five six seven eight nine"),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("１９２.１６８.０.１", "ip", "１９２.１６８.０.１"),
        ("+4⁠9 30 12345678", "phone", "+4⁠9 30 12345678"),
    ],
)
def test_disguises(text, kind, found):
    spans = [(s["kind"], text[s["start"] : s["end"]], s["base"]) for s in all_spans(text)]
    assert (kind, found, False) in spans


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("call +1 415 five five 5 0100", "phone", "+1 415 five five 5 0100"),
        ("+49 30 one two 345678", "phone", "+49 30 one two 345678"),
        ("plus 49 30 12345678", "phone", "plus 49 30 12345678"),
        ("joe (  at\t) example.com", "email", "joe (  at\t) example.com"),
        ("joe\t@ example.com", "email", "joe\t@ example.com"),
        ("jane at example . com", "email", "jane at example . com"),
        ("+1 415 fİve five 5 0100", "phone", "+1 415 fİve five 5 0100"),
    ],
)
def test_disguises_whatever_else_the_text_holds(text, kind, found):
    for t in (text, f"{text}, an anecdote", f"an appointment: {text}"):
        assert (kind, found, False) in [(s["kind"], t[s["start"] : s["end"]], s["base"]) for s in all_spans(t)]


def test_gate_loses_nothing(monkeypatch):
    from turnstone.llm import pii as module

    rng = random.Random(11)
    bits = ["one", "Five", "fünf", "zéro", "oh", "un", "plus", "+", "4", "11", "1111", "4111", "192", ".", "-", "(", ")", "[", "]", " ", " ", " ", "  ", "\t", "\n", ", ", "@", "at", "AT", "dot", "Punkt", "joe", "x", "com", "example.com", "&#64;", "&period;", "_at_", "İ"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(3, 22))) for _ in range(60_000)]
    texts += [" ".join(rng.choice(["one", "5", "two", "4", "1", "+", "."]) for _ in range(rng.randrange(4, 20))) for _ in range(10_000)]
    gated = [all_spans(t) for t in texts]
    monkeypatch.setattr(module, "_disguised", lambda lower: True)
    assert [(t, g) for t, g in zip(texts, gated, strict=True) if g != all_spans(t)] == []
    assert sum(not s["base"] for g in gated for s in g) > 100


@pytest.mark.parametrize("text", ["a look at example.com", "he is at home. dot the i", "one two three", "drei vier fünf sechs", "x² + y³ = 12 · 5", "", "at dot com"])
def test_clean_texts_stay_clean(text):
    assert all_spans(text) == []


@pytest.mark.parametrize("part", [" ", "\n", "-", "-at-", "7", "=", "x", "one ", "[", "@ ", "+ ", ". ", " at a"])
def test_long_runs_are_quick(part):
    run = part * (400_000 // len(part))
    for text in (f"joe @{run}", f"joe at{run}", f"a dot{run}b", f"1{run}one", f"+{run}1", run):
        began = time.time()
        all_spans(text)
        assert time.time() - began < 10
    assert ("email", 0, 400_025) in [(s["kind"], s["start"], s["end"]) for s in all_spans("joe" + " " * 400_000 + "[at] example [dot] com...")] or part != " "


def test_pii_report(spark, docs, texts, empty_docs):
    extra = ["joe@example.com joe (at) example (dot) com 10.0.0.1", None]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    all_texts = dict(enumerate(texts)) | {1000 + i: t for i, t in enumerate(extra)}
    for r in pii_report(clashing(df)).collect():
        t = all_texts[r.doc_id] or ""
        base = brute(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == list(map(len, base))
        listed = ",".join(f"{k}:{a}:{b}" for k, x in zip(("email", "ip", "card", "phone"), base, strict=True) for a, b in x)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans == ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in all_spans(t))
        added = Counter(s["kind"] for s in all_spans(t) if not s["base"])
        assert [r.added_email, r.added_ip, r.added_card, r.added_phone, r.n_added] == [*(added[k] for k in ("email", "ip", "card", "phone")), added.total()]
        assert r.has_pii == bool(r.spans)
    assert find_pii(empty_docs).count() == 0


# -- 6 ------------------------------------------------------------------------


def test_gram_counts():
    texts = ["Ab, ab", "", None or "12", "x\0y"]
    owner, gram, count = gram_counts(texts)
    name = lambda g: "".join(chr(int(g) >> 21 * p & 0x1FFFFF) for p in range(3))
    got = {(int(o), name(g)): int(n) for o, g, n in zip(owner, gram, count, strict=True)}
    want = Counter()
    for i, t in enumerate(texts):
        s = re.sub(r"[^a-z]+", " ", f" {t.lower()} ")
        want.update((i, s[k : k + 3]) for k in range(len(s) - 2))
    assert got == dict(want)


def test_languages(spark, empty_docs):
    rng = random.Random(4)
    kinds = {"xx": "kra dro zum gri bak".split(), "yy": "lae noi mia sue oea".split(), "zz": "schp tchk ngth rpst wrch".split()}
    rows = [(i, "".join(rng.choice(kinds[lang]) + rng.choice(["", " "]) for _ in range(40)), lang if i % 5 else None, lang) for i, lang in ((i, rng.choice(sorted(kinds))) for i in range(300))]
    truth = {r[0]: r[3] for r in rows}
    odd = [(1000, None, "xx"), (1001, "", None), (1002, "12 34 !", "yy"), (None, "kra dro zum", None)]
    df = spark.createDataFrame([r[:3] for r in rows] + odd, "doc_id long, text string, lang string")
    got = language_report(clashing(df)).collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)
    assert language_report(empty_docs).count() == 0
    assert {r.lang_pred for r in predict(df, {}).collect()} == {"und"}
    # lang, source and id of a row don't matter to its prediction
    p = learn(df.where(~held_out()))
    a = {r.text: r.lang_pred for r in predict(df, p, keep=("text",)).collect()}
    b = {r.text: r.lang_pred for r in predict(df.withColumn("doc_id", F.lit(7)).withColumn("lang", F.lit("zz")), p, keep=("text",)).collect()}
    assert a == b


def test_languages_by_whole_vectors(spark):
    """Every n-gram bound by itself, every text and language bundled in whole numbers."""
    rng = random.Random(14)
    kinds = {"xx": "kra dro zum gri".split(), "yy": "lae noi mia sué".split(), "zz": "kra noi tchk ngth".split()}
    texts = [(i, " ".join(rng.choices(kinds[lang], k=rng.randrange(1, 30))).title() + rng.choice(["", " 1!", "\n"]), lang) for i, lang in enumerate(rng.choices(sorted(kinds), k=60))]

    def vector(text):
        s = re.sub(r"[^\w]|[\d_]", " ", f" {text.lower()} ")
        s = re.sub(" +", " ", s)
        total = np.zeros(1024, dtype=np.int64)
        for k in range(len(s) - 2):
            bound = np.ones(1024, dtype=np.int64)
            for place, letter in enumerate(s[k : k + 3]):
                bound *= np.roll(letter_vector(ord(letter)), place)
            total += bound
        return total

    own = {i: vector(t) for i, t, _ in texts}
    languages = {lang: sum(own[i] for i, _, x in texts if x == lang) for lang in kinds}
    cosine = lambda a, b: a @ b / np.sqrt(float(a @ a) * float(b @ b))
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    for r in predict(df, learn(df)).collect():
        near = {lang: cosine(own[r.doc_id], v) for lang, v in languages.items()}
        assert r.lang_pred == max(sorted(near), key=near.get) and r.score == pytest.approx(max(0, near[r.lang_pred]), abs=1e-5)


# -- 7 ------------------------------------------------------------------------

CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(CASE)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark, texts, empty_docs):
    long = "x" * 45
    extra = [(500 + i, f"{long}\n{long}\n É{long}\n{'é' * 40}\r") for i in range(6)] + [(None, long), (None, None), (503, f"{long}\nother\n{long}"), (3, texts[3]), (600, long), (601, "\n\n")]
    rows = [*enumerate(texts), *extra]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in drop_common_lines(clashing(df)).collect()), key=order)
    assert got == sorted(brute_lines(rows), key=order)
    digests = Counter(r.kept_sha256 for r in line_report(df).collect())
    assert digests == Counter(hashlib.sha256(r[3].encode()).hexdigest() for r in brute_lines(rows))
    assert any(r[2] for r in got) and line_report(empty_docs).count() == 0


# -- 9 ------------------------------------------------------------------------


def brute_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CASE))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(rows):
    sets = [(i, brute_sets(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return [(i, len(s), min((j for j in least[find(k)] if j is not None), default=None)) for k, (i, s) in enumerate(sets)]


def test_shingles():
    texts = ["", " \n", "A b C", "a B c", "a b c d e", "a b c d e f g a b c d e", "É é", "x" * 3000 + " y " * 4000]
    for t, s in zip(texts, shingle_sets(texts), strict=True):
        assert len(s) == len(brute_sets(t)) and (np.diff(s.astype(object)) > 0).all()
    a, b = shingle_sets(["A b C", "a B c"])
    assert a.tolist() == b.tolist() and shingle_sets(["a b c"])[0].tolist() == a.tolist() != shingle_sets(["a c b"])[0].tolist()


def test_filters_are_bounds():
    rng = random.Random(6)
    for _ in range(300):
        u = rng.sample(range(200), rng.randrange(1, 60))
        a, b = (np.unique(np.array([x * 2**56 % 2**64 + x for x in rng.sample(u, rng.randrange(1, len(u) + 1))], dtype=np.uint64)) for _ in range(2))
        common = len(np.intersect1d(a, b))
        assert suffix_bound(a, b) >= common
        if 100 * common >= 75 * (len(a) + len(b) - common):
            assert common > len(a) - prefix_size(len(a), 75)
    sets = [np.unique(np.array(rng.sample(range(40), 30), dtype=np.uint64)) for _ in range(30)]
    near = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    assert all(is_link(sets[i], sets[j], 75) == near(i, j) for i in range(30) for j in range(30))
    for side in (np.zeros(30, dtype=bool), np.arange(30) % 3 == 0):
        part = np.arange(30) // 2
        links = {(i, j) for j in range(30) for i in range(j) if near(i, j) and (side[i] != side[j] or not side.any()) and part[i] != part[j]}
        found = linked(sets, side, part, 75)  # a spanning forest of the same components of parts

        def parts(pairs, part=part):
            of = list(range(15))
            for i, j in pairs:
                of = [min(of[part[i]], of[part[j]]) if x in (of[part[i]], of[part[j]]) else x for x in of]
            return of

        assert links and parts(found) == parts(links) and len(found) <= len(links)


def test_join(spark, texts, empty_docs):
    rng = random.Random(8)
    group = words(rng, 60).split()
    many = [" ".join("z%d" % rng.randrange(9) if rng.random() < 0.02 else w for w in group) for _ in range(70)]  # more than are paired
    rows = [*enumerate(texts), *((400 + i, t) for i, t in enumerate(many)), (None, texts[0]), (None, "only here with a null id"), (2, texts[2]), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = lambda x: (x[0] is None, x[0] or 0, str(x[1:]))
    got = sorted((tuple(r) for r in ngram_join(clashing(df)).collect()), key=order)
    assert got == sorted(brute_join(rows), key=order)
    assert ngram_join(empty_docs).count() == 0


def templates(rng, n, words_of=60, keep=0.93):
    """Texts of one template, some linked with each other and some not."""
    group = words(rng, words_of).split()
    return [" ".join(w if rng.random() < keep else f"z{rng.randrange(9)}" for w in group) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_shingles_with_many_classes(spark, monkeypatch, seed):
    from turnstone.llm import ngram_join as module

    for name, value in {"MOST_PAIRED": 5, "STAR": 7, "BLOCK": 8, "BLOCK_SHINGLES": 700}.items():
        monkeypatch.setattr(module, name, value)
    if seed == 2:  # all shingles of some frequency are dealt to parts
        monkeypatch.setattr(module, "LEVELS", np.array([1, 2, 3, 4, 6]))
        monkeypatch.setattr(module, "SALTS", 3)
    rng = random.Random(9 + seed)
    rows = list(enumerate(templates(rng, 60, 80, 0.985) + templates(rng, 90, 60, 0.96) + templates(rng, 40, 30, 0.95) + [words(rng, 50) for _ in range(20)]))
    rows += [(1000 + i, t + " " + words(rng, i % 30)) for i, t in rows[:40]]
    df, rest, compared = spark.createDataFrame(rows, DOCS.split(", lang")[0]).repartition(3), module._rest, []
    monkeypatch.setattr(module, "_rest", lambda *a: compared.append(rest(*a)) or compared[-1])
    assert sorted(tuple(r) for r in ngram_join(df).collect()) == sorted(brute_join(rows))
    assert compared  # not all was linked by the pairs of neighbours and heads


def test_words_of_one_polynomial_hash_do_not_link(spark):
    from .test_tokens import thue_morse

    for n in (1024, 2048, 4096):
        rows = list(enumerate(thue_morse(n)))
        assert [tuple(r) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [(0, 1, 0), (1, 1, 1)]
