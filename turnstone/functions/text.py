"""Column functions on text: tokens, surfaces, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters and numbers.
TOKEN = r"[\p{L}\p{N}]+"


def lexical_terms(text: Column) -> Column:
    """Distinct lower-case tokens in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1), F.lower))


def substring_count(lowered: Column, term: Column) -> Column:
    """Non-overlapping occurrences of term as a substring, so `cat` also counts inside `concat`."""
    removed = F.char_length(lowered) - F.char_length(F.replace(lowered, term, F.lit("")))
    return F.floor(removed / F.char_length(term))


def lexical_score(matched: Column, frequency: Column, terms: Column) -> Column:
    """0.85 for the share of terms matched, 0.15 for how often (2 a term is full)."""
    return F.lit(0.85) * matched / terms + F.lit(0.15) * F.least(F.lit(1.0), frequency / (F.lit(2.0) * terms))


def dream_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of more than one byte."""
    return F.filter(lexical_terms(text), lambda t: F.octet_length(t) > 1)


def identity_tokens(name: Column, generic: list[str]) -> Column:
    """Tokens of at least 4 bytes that aren't generic words."""
    return F.filter(lexical_terms(name), lambda t: (F.octet_length(t) >= 4) & ~t.isin(generic))


def blank_trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends; Spark's trim takes blanks only."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def space_trimmed(text: Column) -> Column:
    """text without spaces of any width at its ends, as DuckDB's trim has it; tabs and line ends stay."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def normalize_surface(name: Column) -> Column:
    return F.lower(blank_trimmed(name))


def normalized_surface(name: Column) -> Column:
    """Lower case, letters and numbers only."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def per_mille(part: Column, whole: Column) -> Column:
    """Whole thousandths, rounded down; 0 of nothing is 0."""
    return F.when(whole > 0, F.expr("1000") * part / whole).otherwise(0).cast("long")


def _common_and_union(a: Column, b: Column) -> tuple[Column, Column]:
    common = F.size(F.array_intersect(a, b)).cast("long")
    return common, F.size(a) + F.size(b) - common  # no union is built


def jaccard_per_mille(a: Column, b: Column) -> Column:
    """Of arrays without repeated elements, in whole thousandths."""
    return per_mille(*_common_and_union(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeated elements; 0 if both are empty."""
    common, union = _common_and_union(a, b)
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def reciprocal_rank(rank: Column, weight: float, k: int = 60) -> Column:
    """weight / (k + rank); 0 without a rank."""
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))
