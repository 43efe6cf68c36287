"""Operator 5: personal data, found also behind disguises, in source offsets.

Base spans are found in the text as it is. Transducers then rewrite a text step by step on a tape
that knows, for each character, which source characters it came from: homoglyphs become the
letters they look like and invisible characters go; spelled digits become digits; at/dot
disguises become @ and dots. The same detectors run over the tape, and what they find there is
carried back to source characters. Such a span is added if its text was rewritten and it touches
no base span of its kind. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[Span]:
    """Each @ with the local characters before it, as far back as the match before allows."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            low = m.end()
            out.append((start, low))
        at = text.find("@", low if m else at + 1)
    return out


def ips(text: str) -> list[Span]:
    """Dotted numbers in fours: a longer row of numbers gives one match after another."""
    out = []
    for m in _NUMBERS.finditer(text):
        parts = m[0].split(".") if m.end() - m.start() > 6 else ()
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                out.append((at, at + size))
            at += size + 1
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []


DETECTORS: tuple[Callable[[str], list[Span]], ...] = (emails, ips, cards, phones)


def base_spans(text: str) -> list[list[Span]]:
    """The spans of each kind in the text as it is."""
    if not _DIGIT.search(text):
        return [emails(text), [], [], []]
    return [f(text) for f in DETECTORS]


class Tape:
    """A rewritten text; starts and ends hold the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str]) -> bool:
        texts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            new = to(m)
            texts += (self.text[at:a], new)
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        if not texts:
            return False
        self.text = "".join((*texts, self.text[at:]))
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]
        return True


# Letters of other scripts and the ASCII letters they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v", "к": "k", "м": "m", "т": "t", "п": "n", "г": "r",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ѐ": "e", "ӓ": "a", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".", "․": ".", "·": ".", "•": ".",
}
# Characters without width.
INVISIBLE = "­​‌‍⁠⁡⁢⁣﻿"
# Spelled digits in the corpus' languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_AT_WORD, _DOT_WORD = r"(?:at|arroba|arobase)", r"(?:dot|point|punkt|punto)"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"

_WORDS = re.compile(rf"(?<!\w){_DIGIT_WORD}(?!\w)", re.I)
_GAP = re.compile(r"[\s,-]+")
_GAP_AFTER_DIGIT = re.compile(r"[0-9]([\s,-]+)$")
_PLUS = re.compile(rf"(?<!\w)plus\s++(?={_DIGIT_WORD}(?!\w)|[0-9])|(?<=\+)\s++(?={_DIGIT_WORD}(?!\w)|[0-9])", re.I)
# White space is taken in as a whole (possessively) and only from where it begins, and a domain's label
# has 63 signs at most, so that no run of white space or signs is read again from each of its places.
_BLANKS, _LABEL = r"(?:(?<!\s)\s++)?", r"[A-Za-z0-9-]{1,63}+"
_NEXT_DOT = rf"(?:\s*+{_OPEN}\s*+{_DOT_WORD}\s*+{_CLOSE}\s*+|\s++{_DOT_WORD}\s++|\s++\.\s++)"
_AT_IN_BRACKETS = re.compile(rf"{_BLANKS}{_OPEN}\s*+(?:{_AT_WORD}|@)\s*+{_CLOSE}\s*+|&#64;|&commat;", re.I)
_AT_WORD_NEEDS_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s++{_AT_WORD}\s++(?={_LABEL}{_NEXT_DOT}[A-Za-z0-9-])", re.I)
_AT_APART = re.compile(rf"(?<=[A-Za-z0-9])(?:\s++@\s*+|@\s++|[-_]at[-_])(?={_LABEL}(?:{_NEXT_DOT}|\.)[A-Za-z0-9-])", re.I)
_DOT = re.compile(rf"{_BLANKS}{_OPEN}\s*+(?:{_DOT_WORD}|\.)\s*+{_CLOSE}\s*+|&#46;|&period;|(?<=[A-Za-z0-9])\s++{_DOT_WORD}\s++(?=[A-Za-z0-9])", re.I)
_DOT_APART = re.compile(r"(?<=[A-Za-z0-9])\s++\.\s++(?=[A-Za-z0-9])")
_TOP_LEVEL = re.compile(r"\.[A-Za-z]{2,24}$")
# What must stand in a lower-cased text that a rewrite changes, for each of the rewrites. Spelled
# digits matter beside a digit or another one (with what joins them or may stand in a number), or
# in a text with an @; a plus, before a digit.
_NEEDED = re.compile(
    rf"{_OPEN}\s*+(?:{_AT_WORD}|@|{_DOT_WORD}|\.)\s*+{_CLOSE}|&(?:#64|commat|#46|period);|\s@|@\s|[-_]at[-_]|[a-z0-9]\s++{_DOT_WORD}\s++[a-z0-9]"
    rf"|[a-z0-9]\s++{_AT_WORD}\s++[a-z0-9-]{{1,63}}+\s++\.\s"
)
_DIGITS_APART = r"[\s,.()-]*+"
_NEAR_DIGITS = re.compile(rf"(?<!\w){_DIGIT_WORD}(?!\w){_DIGITS_APART}(?:[0-9]|{_DIGIT_WORD}(?!\w))|[0-9]{_DIGITS_APART}(?<!\w){_DIGIT_WORD}(?!\w)")
_NEEDED_WITH_AT = re.compile(rf"\s\.\s|(?<!\w){_DIGIT_WORD}(?!\w)")
_NEEDED_PLUS = re.compile(rf"(?:(?<!\w)plus\s++|\+\s++)(?:[0-9]|{_DIGIT_WORD}(?!\w))|\+{_DIGIT_WORD}(?!\w)")


@cache
def folds() -> tuple[dict[int, str], re.Pattern, np.ndarray]:
    """What look-alikes and compatibility forms stand for ('' for invisible ones), a pattern for them,
    and whether a code point is one.

    Compatibility forms follow from Unicode: a character whose NFKC form, or decimal value, is one
    ASCII character.
    """
    table = {ord(a): b for a, b in LOOKALIKES.items()} | {ord(c): "" for c in INVISIBLE}
    for c in range(0xA0, 0x20000):
        if 0xD800 <= c < 0xE000 or c in table:
            continue
        digit = unicodedata.decimal(chr(c), None)
        to = unicodedata.normalize("NFKC", chr(c)) if digit is None else str(digit)
        if len(to) == 1 and to.isascii() and to.isprintable() and chr(c) not in "ªº¹²³":
            table[c] = to
    flags = np.zeros(0x110000, dtype=bool)
    flags[list(table)] = True
    return table, re.compile("[" + "".join(map(re.escape, map(chr, sorted(table)))) + "]"), flags


def _disguised(lower: str) -> bool:
    """Whether a lower-cased text can hold a disguise at all: false only if no rewrite can add a span."""
    if "\u0307" in lower:
        lower = lower.replace("i\u0307", "i")  # the capital I with a dot, which patterns take for an i
    if _NEEDED.search(lower) or _NEAR_DIGITS.search(lower):
        return True
    return ("@" in lower and bool(_NEEDED_WITH_AT.search(lower))) or (("plus" in lower or "+" in lower) and bool(_NEEDED_PLUS.search(lower)))


def added_spans(text: str, base: list[list[Span]]) -> list[list[Span]]:
    """Spans that only show on the rewritten text."""
    none: list[list[Span]] = [[], [], [], []]
    tape, changed = None, False
    if not text.isascii():
        table, pattern, flags = folds()
        if flags[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].any():
            tape = Tape(text)
            changed = tape.rewrite(pattern, lambda m: table[ord(m[0])])
    now = tape.text if tape else text
    if _disguised(now.lower()):
        tape = tape or Tape(text)
        for pattern, to in (
            (_AT_IN_BRACKETS, lambda m: "@"),
            (_AT_WORD_NEEDS_DOT, lambda m: "@"),
            (_AT_APART, lambda m: "@"),
            (_DOT, lambda m: "."),
        ):
            changed |= tape.rewrite(pattern, to)
        changed |= tape.rewrite(_PLUS, lambda m: "" if m[0].isspace() else "+")
        changed |= _spelled_digits(tape)
        if "@" in tape.text:
            changed |= tape.rewrite(_DOT_APART, lambda m: ".")
    if not tape or not changed:
        return none
    out = []
    for kind, (found, old) in enumerate(zip(base_spans(tape.text), base, strict=True)):
        new, starts = [], [a for a, _ in old]
        for a, b in found:
            s, e = tape.starts[a], tape.ends[b - 1]
            k = bisect_left(starts, e)
            if text[s:e] == tape.text[a:b] or (k and old[k - 1][1] > s) or (kind == 0 and not _TOP_LEVEL.search(tape.text[a:b])):
                continue
            new.append((s, e))
        out.append(new)
    return out


def _spelled_digits(tape: Tape) -> bool:
    """Digits for words; what stands between two digits of which one was spelled goes."""
    spelled = [m.span() for m in _WORDS.finditer(tape.text)]
    if not spelled:
        return False
    begins, ends, joins = {a for a, _ in spelled}, {b for _, b in spelled}, []
    for a, b in spelled:
        m = _GAP.match(tape.text, b)
        if m and (m.end() in begins or _DIGIT.match(tape.text, m.end())):
            joins.append(m.span())
        m = _GAP_AFTER_DIGIT.search(tape.text, max(0, a - 8), a)
        if m and m.start(1) not in ends:
            joins.append(m.span(1))
    spans = sorted({*((a, b, SPELLED[tape.text[a:b].lower().replace("i\u0307", "i")]) for a, b in spelled), *((a, b, "") for a, b in joins)})
    texts, starts, stops, done = [], [], [], 0
    for a, b, new in spans:
        texts += (tape.text[done:a], new)
        starts += tape.starts[done:a] + [tape.starts[a]] * len(new)
        stops += tape.ends[done:a] + [tape.ends[b - 1]] * len(new)
        done = b
    tape.text = "".join((*texts, tape.text[done:]))
    tape.starts, tape.ends = starts + tape.starts[done:], stops + tape.ends[done:]
    return True


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def all_spans(text: str) -> list[dict]:
    """The spans of a text, by kind as listed, then start."""
    base = base_spans(text)
    added = added_spans(text, base)
    return [{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for k in range(4) for a, b, is_base in sorted([(*x, True) for x in base[k]] + [(*x, False) for x in added[k]])]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of docs.

    Null text is empty and has no spans. Null ids and repeated rows are kept; other columns are
    ignored; an empty table gives an empty result. Whole texts are read, however long.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(all_spans, texts_of(batch, "text")), _SPAN_TYPE)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, spans {SPANS}").withColumnRenamed("id", id_col)


def span_list(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added_email, added_ip, added_card,
    added_phone, n_added, has_pii): the first four and the digest are those of base spans; spans
    lists all of them; added_... and n_added count what the transducers added."""
    found = find_pii(docs)
    spans = F.col("spans")
    base, added = F.filter(spans, lambda s: s["base"]), F.filter(spans, lambda s: ~s["base"])
    of = lambda which, kind: F.size(F.filter(which, lambda s: s["kind"] == kind)).cast("long")
    counts = [of(base, k).alias(f"n_{k}") for k in KINDS] + [F.sha2(span_list(base), 256).alias("base_sha256"), span_list(spans).alias("spans")] + [of(added, k).alias(f"added_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.size(added).cast("long").alias("n_added"), (F.size(spans) > 0).alias("has_pii"))
