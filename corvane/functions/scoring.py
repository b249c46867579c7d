"""Formulas of ranking as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60
#: Shares and weights of ranking.
EXACT_SHARE, TITLE_BOOST, PATH_BOOST = 0.5, 0.25, 0.25
HEADING_BOOST, HEADING_TIE, COVERAGE_POWER, OTHER_HEADING = 2.0, 0.25, 0.5, 0.5
STRONG_SCORE, STRONG_GAP = 0.85, 0.15
PHRASE_WEIGHT, SYNONYM_WEIGHT, COMPOUND_WEIGHT, TYPO_WEIGHT = 2.0, 0.6, 0.6, 2.0


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_value(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, df: Column, dl: Column, n: Column, mean: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def saturated(score: Column) -> Column:
    """A score between 0 and 1: s / (1 + s), 0 for none."""
    return F.when(score > 0, score / (1 + score)).otherwise(0.0)


def reciprocal(rank: Column, weight: Column | float = 1.0) -> Column:
    return weight / (RRF_K + rank)


def recency(score: Column, now: int, mtime: Column, boost: float, half_life: float) -> Column:
    """A bonus that halves with every half-life of age; none for unknown times."""
    age = F.greatest(F.lit(now) - mtime, F.lit(0))
    return F.when(mtime > 0, score * (1 + boost * F.exp(-age * math.log(2) / half_life))).otherwise(score)


def kind_boost(score: Column, kind: Column, boosts: dict[str, float]) -> Column:
    if not boosts:
        return score
    table = F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair])
    return score * F.coalesce(F.element_at(table, kind), F.lit(1.0))


def closeness(window: Column, slots: int, most: int) -> Column:
    """1 for words side by side, falling with the logarithm of what lies between, 0 from ``most`` on."""
    span = F.greatest(window - slots + 1, F.lit(1))
    return F.greatest(1 - F.log(span) / F.log(F.lit(float(max(most, 2)))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)
