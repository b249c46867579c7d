"""What a hit shows: snippets and highlights, computed for the final rows only."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.errors import QuerySyntaxError
from corvane.functions.edits import fuzzy_reaches
from corvane.functions.patterns import glob_to_regex, word_regex
from corvane.functions.stem import stem
from corvane.functions.text import fold_accents_text, words_of
from corvane.plans import language as q

#: Letters of a snippet, from where on a text is long, and how much of a long one is looked through.
SNIPPET, LONG_BODY, REGION = 240, 24_000, 6_000
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Matcher:
    """What counts as a match in a text: stems, near words, patterns, and phrases of stems."""

    stems: frozenset[str]
    fuzzy: tuple[tuple[str, int], ...]
    patterns: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]

    @classmethod
    def of(cls, tree) -> "Matcher":
        stems, fuzzy, patterns, phrases = set(), [], [], []

        def visit(n) -> None:
            match n:
                case q.Not(_):
                    return
                case q.Term(text):
                    stems.update(map(_stem, words_of(text)))
                case q.Phrase(text, _, near):
                    got = tuple(map(_stem, words_of(text)))
                    if near or len(got) < 2:
                        stems.update(got)
                    else:
                        phrases.append(got)
                case q.Fuzzy(word, most):
                    fuzzy.append((word.lower(), most))
                case q.Wildcard(glob):
                    patterns.append(glob_to_regex(glob))
                case q.Pattern(regex):
                    with suppress(QuerySyntaxError):
                        patterns.append(word_regex(regex))
                case q.Boosted(inner, _) | q.Required(inner):
                    visit(inner)
            for child in getattr(n, "parts", ()):
                visit(child)

        visit(tree)
        return cls(frozenset(stems), tuple(fuzzy), tuple(patterns), tuple(phrases))

    def matches(self, word: str) -> bool:
        w = word.lower()
        return _stem(w) in self.stems or any(fuzzy_reaches(t, w, n) for t, n in self.fuzzy) or any(_whole(p, w) for p in self.patterns)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Matched stretches of a text, in order, without overlaps."""
        found = [(m.start(), m.end(), _stem(m[0].lower())) for m in WORD.finditer(text)]
        out = [(a, b) for a, b, _ in found if self.matches(text[a:b])]
        for phrase in self.phrases:
            for i in range(len(found) - len(phrase) + 1):
                if all(found[i + j][2] == s for j, s in enumerate(phrase)):
                    out.append((found[i][0], found[i + len(phrase) - 1][1]))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(set(out)):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def has_any(self, text: str) -> bool:
        return bool(self.spans(text))


@functools.lru_cache(100_000)
def _whole(pattern: str, word: str) -> bool:
    """Whether a whole word matches, in time linear in the word; a pattern that is no pattern matches nothing."""
    try:
        return pc.match_substring_regex(pa.array([word]), pattern)[0].as_py()
    except pa.ArrowInvalid:
        return False


def _stem(word: str) -> str:
    return stem(fold_accents_text(word))


def snippet(text: str, matcher: Matcher, most: int = SNIPPET) -> tuple[str, list[tuple[int, int]]]:
    """The stretch of a text with the most different matches, cut between words, the earliest of equals; and the matches in it."""
    base = 0
    if len(text) > LONG_BODY:
        first = next((m.start() for m in WORD.finditer(text) if matcher.matches(m[0])), 0)
        base = max(0, first - REGION // 4)
        text = text[base : base + REGION]
    spans = matcher.spans(text)
    if not spans:
        cut = text[:most]
        return (cut.rsplit(None, 1)[0] if len(text) > most and " " in cut else cut).strip(), []
    best, start = -1, 0
    for a, _ in spans:
        inside = {_stem(text[x:y].lower()) for x, y in spans if a <= x and y <= a + most}
        if len(inside) > best:
            best, start = len(inside), a
    lead = max(0, start - most // 4)
    if lead:
        lead = text.find(" ", lead, start) + 1 or start
    end = min(len(text), lead + most)
    if end < len(text):
        end = max(text.rfind(" ", start, end), lead + 1) if " " in text[start:end] else end
    cut = text[lead:end]
    return cut, [(max(a, lead) - lead, min(b, end) - lead) for a, b in spans if a < end and b > lead]


EVIDENCE = "snippet string, marks array<struct<start:int,end:int>>"


def with_snippets(hits: DataFrame, tree, most: int = SNIPPET) -> DataFrame:
    """``hits`` with ``body`` replaced by ``snippet`` and the places to highlight."""
    matcher = Matcher.of(tree)
    kept = [c for c in hits.columns if c != "body"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields if f.name != "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [snippet(t or "", matcher, most) for t in b.column(b.schema.get_field_index("body")).to_pylist()]
            marks = pa.array([[{"start": a, "end": e} for a, e in m] for _, m in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array([s for s, _ in found], pa.string()), marks], names=[*kept, "snippet", "marks"])

    return hits.mapInArrow(run, f"{schema}, {EVIDENCE}")


def marked(text: str, matcher: Matcher, mark: str = "**") -> str:
    """A text with its matches between marks."""
    out, at = [], 0
    for a, b in matcher.spans(text):
        out += [text[at:a], mark, text[a:b], mark]
        at = b
    return "".join([*out, text[at:]])


def materialised(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Stored columns for the rows that are shown; hits are few, so their keys are what is joined."""
    return hits.join(chunks.select("parent_id", "chunk_seq", *(F.col(c) for c in columns)), ["parent_id", "chunk_seq"])
