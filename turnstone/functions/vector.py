"""Column functions on vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def valid(a: Column) -> Column:
    """Not null or empty, finite, and not zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(a.isNotNull() & (F.size(a) > 0) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors that are empty, of different lengths, not finite, or zero."""
    return F.when(valid(a) & valid(b) & (F.size(a) == F.size(b)), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))


def fused(lexical: Column, semantic: Column, lexical_weight: float = 0.45, semantic_weight: float = 0.55) -> Column:
    """Weighted where both are positive, the one as it is where only one is, else 0."""
    left, right = F.coalesce(lexical, F.lit(0.0)), F.coalesce(semantic, F.lit(0.0))
    both = F.lit(lexical_weight) * left + F.lit(semantic_weight) * right
    return F.when((left > 0) & (right > 0), both).when(left > 0, left).when(right > 0, right).otherwise(F.lit(0.0))


def normalised_weights(lexical: float, semantic: float) -> tuple[float, float]:
    """Two weights that add up to 1. Both must be finite and not negative, and one positive."""
    if not all(0 <= w < float("inf") for w in (lexical, semantic)) or lexical + semantic <= 0:
        raise ValueError("weights must be finite, not negative, and not both 0")
    return lexical / (lexical + semantic), semantic / (lexical + semantic)
