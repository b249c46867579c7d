"""How a shown text marks its matches: colours of terms, letters that vary, and words near each other.

A run is (start, end, style, slot): ``hit`` letters are as typed, ``vary`` letters are what a pattern filled in or a misspelling
changed; ``dim`` before either marks a word of a nearness group outside every window that holds the whole group.
``slot`` is the place of the first query word that matches. Only rows that are shown are marked, on Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.functions.edits import aligned, closest_typed, fuzzy_reaches
from corvane.functions.patterns import glob_mask
from corvane.functions.text import words_of
from corvane.operators.evidence import WORD, Matcher, _stem
from corvane.plans import language as q

#: Links' targets and link definitions are in a text but are not shown.
HIDDEN = re.compile(r"\]\([^)\n]*\)|^ {0,3}\[[^\]\n]+\]:.*$", re.M)


@dataclass(frozen=True)
class Marker:
    """What a query's highlights need: its matcher, its words in order, and its nearness groups (stems, slop)."""

    matcher: Matcher
    order: tuple[tuple[str, str], ...] = ()  # kind, word
    groups: tuple[tuple[tuple[str, ...], int], ...] = ()
    free: frozenset[str] = field(default_factory=frozenset)  # stems that stand outside any group too

    @classmethod
    def of(cls, tree) -> "Marker":
        order: list[tuple[str, str]] = []
        groups, free = [], set()

        def visit(n) -> None:
            match n:
                case q.Not(_) | None:
                    return
                case q.Term(text):
                    order.extend(("word", w) for w in words_of(text))
                    free.update(map(_stem, words_of(text)))
                case q.Phrase(text, slop, near):
                    order.extend(("word", w) for w in words_of(text))
                    if near:
                        groups.append((tuple(dict.fromkeys(map(_stem, words_of(text)))), slop))
                case q.Fuzzy(word, most):
                    order.append((f"near{most}", word.lower()))
                case q.Wildcard(glob):
                    order.append(("glob", glob.lower()))
                case q.Pattern(regex):
                    order.append(("regex", regex))
                case q.Boosted(inner, _) | q.Required(inner):
                    visit(inner)
            for child in getattr(n, "parts", ()):
                visit(child)

        visit(tree)
        return cls(Matcher.of(tree), tuple(dict.fromkeys(order)), tuple(groups), frozenset(free))

    def reaches(self, kind: str, typed: str, word: str) -> bool:
        w = word.lower()
        if kind == "word":
            return _stem(w) == _stem(typed)
        if kind.startswith("near"):
            return fuzzy_reaches(typed, w, int(kind[4:]))
        if kind == "glob":
            return glob_mask(typed, w) is not None
        return Matcher.of(q.Pattern(typed)).matches(w)

    def slot(self, word: str) -> int:
        """The place of the first query word that matches; 0 if none does."""
        return next((i for i, (kind, typed) in enumerate(self.order) if self.reaches(kind, typed, word)), 0)

    def mask(self, word: str) -> list[bool]:
        """For each letter whether the query typed it."""
        w = word.lower()
        typed = [t for kind, t in self.order if (kind == "word" or kind.startswith("near")) and self.reaches(kind, t, w)]
        if typed:
            return aligned(closest_typed(w, typed), w)
        for kind, glob in self.order:
            if kind == "glob" and (found := glob_mask(glob, w)) is not None:
                return found
        return [True] * len(word)

    def tiers(self, stems: list[str]) -> tuple[set[int], set[int]]:
        """Places of words whose mark depends on a nearness group, and those of them within a window that holds the whole group."""
        members, close = set(), set()
        for group, slop in self.groups:
            members |= {i for i, s in enumerate(stems) if s in group}
            close |= within_windows(stems, group, slop)
        return {i for i in members if stems[i] not in self.free}, close

    def runs(self, text: str) -> list[tuple[int, int, str, int]]:
        """Runs of all matches of a text, in order, none over another; of phrases, what lies between their words too."""
        found = [(m.start(), m.end()) for m in WORD.finditer(text)]
        members, close = self.tiers([_stem(text[a:b].lower()) for a, b in found]) if self.groups else (set(), set())
        out: list[tuple[int, int, str, int]] = []
        whole = self.matcher.spans(text)
        for i, (a, b) in enumerate(found):
            if not any(x <= a and b <= y for x, y in whole):
                continue
            word = text[a:b]
            slot, dim = self.slot(word), "dim " if i in members and i not in close else ""
            mask = self.mask(word) if len(word.lower()) == len(word) else [True] * len(word)
            edges = [k for k in range(len(mask)) if not k or mask[k] != mask[k - 1]]
            out += [(a + k, a + e, dim + ("hit" if mask[k] else "vary"), slot) for k, e in zip(edges, [*edges[1:], len(mask)])]
        covered = {k for a, b, _, _ in out for k in range(a, b)}
        out += [(a, b, "hit", 0) for a, b in gaps(whole, covered)]
        return sorted(out)

    def has_full(self, text: str) -> bool:
        """Whether some match of a text is not dimmed."""
        return any(not style.startswith("dim") for _, _, style, _ in self.runs(text))


def within_windows(stems: list[str], group: tuple[str, ...], slop: int) -> set[int]:
    """Places of a group's words in any window of ``slop`` words more than the group has that holds each of its words."""
    places = {g: np.array([i for i, s in enumerate(stems) if s == g], np.int64) for g in dict.fromkeys(group)}
    if not places or any(not len(p) for p in places.values()):
        return set()
    every = np.sort(np.concatenate(list(places.values())))
    last = every + slop + len(places) - 1
    whole = np.all([np.searchsorted(p, last, side="right") > np.searchsorted(p, every) for p in places.values()], axis=0)
    # Windows that hold all are intervals of places: a place is in one of them if more have begun than ended.
    depth = np.zeros(len(stems) + 1, np.int64)
    np.add.at(depth, every[whole], 1)
    np.add.at(depth, np.minimum(last[whole] + 1, len(stems)), -1)
    return set(every[np.cumsum(depth)[every] > 0].tolist())


def gaps(spans: list[tuple[int, int]], covered: set[int]) -> list[tuple[int, int]]:
    """The stretches of spans that nothing covers."""
    out = []
    for a, b in spans:
        open_ = [k for k in range(a, b) if k not in covered]
        begins = [k for n, k in enumerate(open_) if not n or open_[n - 1] != k - 1]
        ends = [k + 1 for n, k in enumerate(open_) if n + 1 == len(open_) or open_[n + 1] != k + 1]
        out += list(zip(begins, ends))
    return out


RUNS = "array<struct<start:int,end:int,style:string,slot:int>>"


def with_runs(rows: DataFrame, tree, column: str = "body") -> DataFrame:
    """``rows`` with ``runs``, the highlights of a text column."""
    marker = Marker.of(tree)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("style", pa.string()), ("slot", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("start", "end", "style", "slot"), r)) for r in marker.runs(t or "")] for t in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "runs"])

    return rows.mapInArrow(run, f"{schema}, runs {RUNS}")


def keep_shown(rows: DataFrame, tree, column: str = "body") -> DataFrame:
    """Rows whose text shows a match; targets of links are not shown."""
    matcher = Matcher.of(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown = [matcher.has_any(HIDDEN.sub(lambda m: "]" if m[0].startswith("]") else "", t or "")) for t in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield b.filter(pa.array(shown, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
