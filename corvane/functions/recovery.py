"""Measures by which text of a page is trusted: coverage and legibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import words

COVERAGE_GATE, LEAST_TOKENS = 0.70, 20
LEGIBLE, LEAST_LETTERS, MOST_BROKEN = 0.80, 30, 0.03


def coverage(flat: Column, structured: Column) -> Column:
    """Share of the flat text's distinct words that the structured text has; 1 for a flat text without words."""
    want, have = F.array_distinct(words(flat)), F.array_distinct(words(structured))
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, have)) / F.size(want)).otherwise(1.0)


def needs_recovery(flat: Column, structured: Column) -> Column:
    return (F.size(words(flat)) >= LEAST_TOKENS) & (coverage(flat, structured) < COVERAGE_GATE)


def letter_share(text: Column) -> Column:
    """Letters, digits and common marks among characters that are no white space."""
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    good = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}.,;:!?'()\-]", ""))
    return F.when(solid > 0, good / solid).otherwise(1.0)


def legible(text: Column) -> Column:
    """Enough ordinary characters and few broken ones; short texts always are."""
    n = F.length(F.regexp_replace(text, r"\s", ""))
    broken = F.length(F.regexp_replace(text, r"[^�\p{Co}]", ""))
    return (n < LEAST_LETTERS) | ((letter_share(text) >= LEGIBLE) & (broken <= MOST_BROKEN * n))
