"""Query trees compiled to DataFrame plans over an index.

Every scored leaf (word, phrase, pattern, field clause) is resolved to terms on the driver, from the
dictionary. One job then reads the postings of all these terms, scores each, and groups them by chunk
with a column per leaf: one shuffle, whatever the tree's shape. The tree itself is a pair of Column
expressions over these columns, whether a chunk matches and its score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.errors import QuerySyntaxError
from corvane.functions import scoring
from corvane.functions.edits import fuzzy_reaches, leading_edits
from corvane.functions.patterns import glob_to_regex, literal_prefixes, word_regex
from corvane.functions.text import stems_of, words_of
from corvane.plans import language as q

MOST_VARIANTS, RANKED_VARIANTS = 50_000, 256
KEYS = ("parent_id", "chunk_seq")


@dataclass
class Leaf:
    """Slots of terms in a field; one slot is a word (or any of its variants), more are a phrase."""

    number: int
    field: str
    slots: list[list[str]]
    slop: int = 0
    near: bool = False
    share: float = 1.0
    blended: bool = False  # variants of a pattern score with the commonest variant's rarity


@dataclass
class Compiled:
    leaves: list[Leaf]
    matches: Column
    score: Column
    anchored: bool = False  # what matches need not have any leaf
    reads_chunks: bool = False  # some part is a condition on columns of chunks


class Compiler:
    def __init__(self, index, main: str = "words", exact: str | None = None):
        """``main`` is the field words are looked up in; with ``exact`` a word's score is shared between both."""
        self.index, self.main, self.exact = index, main, exact
        self.leaves: list[Leaf] = []
        self.reads_chunks = False

    def compile(self, tree) -> Compiled:
        if tree is None:
            return Compiled([], F.lit(True), F.lit(0.0), True)
        matches, score, anchored = self._node(tree)
        return Compiled(self.leaves, matches, score, anchored, self.reads_chunks)

    def _column(self, leaf: Leaf) -> Column:
        return F.col(f"s{leaf.number}")

    def _leaf(self, fld: str, slots: list[list[str]], **more) -> tuple[Column, Column, bool]:
        slots = [s for s in slots]
        if not slots or any(not s for s in slots):
            return F.lit(False), F.lit(0.0), False
        leaf = Leaf(len(self.leaves), fld, slots, **more)
        self.leaves.append(leaf)
        return self._column(leaf) > 0, F.coalesce(self._column(leaf), F.lit(0.0)), False

    def _analysed(self, text: str, fld: str) -> list[str]:
        return stems_of(text) if fld in self.index.stemmed_fields else words_of(text)

    def _node(self, node) -> tuple[Column, Column, bool]:
        match node:
            case q.Term(text):
                return self._words(text)
            case q.Phrase(text, slop, near):
                return self._phrase(text, slop, near)
            case q.Wildcard(glob):
                return self._glob(glob)
            case q.Pattern(regex):
                return self._pattern(regex)
            case q.Fuzzy(word, most):
                found = self.fuzzy_terms(word, most)
                return self._leaf(self.main, [found])
            case q.FieldClause():
                matches, self.reads_chunks = self.index.predicate(node), True
                return matches, F.when(matches, 1.0).otherwise(0.0), True
            case q.Boosted(inner, by):
                m, s, a = self._node(inner)
                return m, s * by, a
            case q.Not(_) | q.Required(_):
                return self._group((node,), F.lit(0.0))
            case q.And(parts):
                return self._group(tuple(p if isinstance(p, (q.Not, q.Required)) else q.Required(p) for p in parts), F.lit(0.0))
            case q.Or(parts):
                return self._group(parts, F.lit(0.0))
            case q.Alternatives(parts):
                return self._best(parts)
            case q.Everything():
                return F.lit(True), F.lit(0.0), True
        raise QuerySyntaxError(f"cannot compile {node!r}")

    def _group(self, parts: tuple, zero: Column) -> tuple[Column, Column, bool]:
        """Required parts all match; without any, one of the optional ones does. Scores of what matches add."""
        must, may, never, score = [], [], [], zero
        for p in parts:
            inner = p.node if isinstance(p, (q.Not, q.Required)) else p
            m, s, a = self._node(inner)
            if isinstance(p, q.Not):
                never.append((m, a))
                continue
            (must if isinstance(p, q.Required) else may).append((m, a))
            score = score + F.when(m, s).otherwise(0.0)
        anchored = not must and not may
        matches = F.lit(True)
        if must:
            matches = reduce(lambda a, b: a & b, [m for m, _ in must])
            anchored = all(a for _, a in must)
        elif may:
            matches = reduce(lambda a, b: a | b, [m for m, _ in may])
            anchored = any(a for _, a in may)
        for m, _ in never:
            matches = matches & ~F.coalesce(m, F.lit(False))
        return F.coalesce(matches, F.lit(False)), score, anchored

    def _best(self, parts: tuple) -> tuple[Column, Column, bool]:
        plain = [p for p in parts if not isinstance(p, (q.Not, q.Required))]
        signed = tuple(p for p in parts if isinstance(p, (q.Not, q.Required)))
        got = [self._node(p) for p in plain]
        if not got:
            return self._group(signed, F.lit(0.0))
        matches = reduce(lambda a, b: a | b, [F.coalesce(m, F.lit(False)) for m, _, _ in got])
        scores = [F.when(m, s).otherwise(0.0) for m, s, _ in got]
        score = scores[0] if len(scores) == 1 else F.greatest(*scores)
        anchored = any(a for _, _, a in got)
        if signed:
            m, s, _ = self._group(signed, F.lit(0.0))
            required = any(isinstance(p, q.Required) for p in signed)
            return (m if required else matches & m), score + s, anchored
        return matches, score, anchored

    def _words(self, text: str) -> tuple[Column, Column, bool]:
        found = self._analysed(text, self.main)
        if len(found) > 1:
            return self._phrase(text, 0, False)
        if not found:
            return F.lit(False), F.lit(0.0), False
        if self.exact is None:
            return self._leaf(self.main, [found])
        m, s, _ = self._leaf(self.main, [found], share=1 - scoring.EXACT_SHARE)
        _, more, _ = self._leaf(self.exact, [words_of(text)], share=scoring.EXACT_SHARE)
        return m, s + more, False

    def _phrase(self, text: str, slop: int, near: bool) -> tuple[Column, Column, bool]:
        slots = []
        for part in text.split():
            if re.search(r"[*?]", part):
                slots.append(self.glob_terms(part.lower(), self.main))
            else:
                slots += [[w] for w in self._analysed(part, self.main)]
        if len(slots) == 1:
            return self._leaf(self.main, slots)
        return self._leaf(self.main, slots, slop=slop, near=near)

    def glob_terms(self, glob: str, fld: str) -> list[str]:
        head = re.match(r"[^*?]*", glob)[0]
        rows = self.index.dictionary(fld)
        rows = rows.filter(F.col("term").startswith(head)) if head else rows
        if re.fullmatch(r"[^*?]+\*", glob):
            return [r["term"] for r in rows.select("term").orderBy("term").limit(MOST_VARIANTS).collect()]
        return [r["term"] for r in rows.filter(F.col("term").rlike(glob_to_regex(glob))).select("term").orderBy("term").limit(MOST_VARIANTS).collect()]

    def _field_for_patterns(self) -> str:
        return self.exact or self.main

    def _glob(self, glob: str) -> tuple[Column, Column, bool]:
        return self._leaf(self._field_for_patterns(), [self.glob_terms(glob, self._field_for_patterns())], blended=not re.fullmatch(r"[^*?]+\*", glob))

    def _pattern(self, regex: str) -> tuple[Column, Column, bool]:
        """A pattern that is none, or that needs backtracking, matches nothing."""
        fld = self._field_for_patterns()
        rows = self.index.dictionary(fld)
        try:
            whole = word_regex(regex)
        except QuerySyntaxError:
            return self._leaf(fld, [])
        heads = literal_prefixes(regex)
        if heads:
            rows = rows.filter(reduce(lambda a, b: a | b, [F.col("term").startswith(h) for h in heads]))
        found = [r["term"] for r in matching_terms(rows, whole).select("term").orderBy("term").limit(MOST_VARIANTS).collect()]
        return self._leaf(fld, [found], blended=True)

    def fuzzy_terms(self, word: str, most: int) -> list[str]:
        """Dictionary terms in reach: the Levenshtein distance bounds them (a swap costs it two), then the exact test."""
        typed = "".join(self._analysed(word, self.main)) or word.lower()
        rows = self.index.dictionary(self.main)
        near = (F.col("term").startswith(typed[:1]) & (F.levenshtein("term", F.lit(typed), 2 * most) >= 0)) | F.col("term").isin(sorted(leading_edits(typed)) if most else [typed])
        found = rows.filter((F.abs(F.length("term") - len(typed)) <= most) & near).select("term").collect()
        return sorted(r["term"] for r in found if fuzzy_reaches(typed, r["term"], most))


def matching_terms(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows of a dictionary whose whole term matches, in time that grows with the term's length whatever the pattern; a pattern that
    this dialect does not know matches nothing."""
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return rows.limit(0)

    def run(batches):
        for batch in batches:
            yield batch.filter(pc.match_substring_regex(batch.column(0), pattern))

    return rows.select("term").mapInArrow(run, "term string")


def scored(index, compiled: Compiled) -> DataFrame:
    """(parent_id, chunk_seq, score) of all chunks that match, before filters."""
    if not compiled.leaves:
        rows = index.chunks
        return rows.filter(compiled.matches).select(*KEYS, compiled.score.cast("double").alias("score"))
    hits = leaf_scores(index, compiled.leaves)
    if compiled.anchored:
        hits = index.chunks.join(hits, list(KEYS), "left")
    elif compiled.reads_chunks:
        hits = index.chunks.join(hits, list(KEYS))
    return hits.filter(compiled.matches).select(*KEYS, compiled.score.cast("double").alias("score"))


def leaf_scores(index, leaves: list[Leaf]) -> DataFrame:
    """One row per chunk with a posting of any leaf: a score column ``s<i>`` per leaf, null where it does not match."""
    spark = index.spark
    rows = [(leaf.number, j, leaf.field, t) for leaf in leaves for j, slot in enumerate(leaf.slots) for t in dict.fromkeys(slot)]
    fields = index.field_stats()
    df_of = index.frequencies({(r[2], r[3]) for r in rows})
    terms = sorted({r[3] for r in rows})
    postings = index.postings.filter(F.col("field").isin(sorted({r[2] for r in rows})))
    if len(terms) <= 1_000:
        postings = postings.filter(F.col("term").isin(terms))
    rarity = []
    for leaf in leaves:
        n = fields[leaf.field][0]
        common = max((df_of.get((leaf.field, t), 0) for s in leaf.slots for t in s), default=0)
        for j, slot in enumerate(leaf.slots):
            for t in dict.fromkeys(slot):
                df = df_of.get((leaf.field, t), 0)
                rarity.append((leaf.number, j, leaf.field, t, scoring.idf_value(n, common if leaf.blended else df) * leaf.share, fields[leaf.field][1]))
    # One row per term of the query, bounded by the language's limits.
    asked = F.broadcast(spark.createDataFrame(rarity, "leaf int, slot int, field string, term string, idf double, mean double"))
    joined = postings.join(asked, ["field", "term"])
    part = F.col("idf") * F.col("tf") * (scoring.K1 + 1) / (F.col("tf") + scoring.K1 * (1 - scoring.B + scoring.B * F.col("dl") / F.col("mean")))
    aggregates = []
    for leaf in leaves:
        mine = F.col("leaf") == leaf.number
        if len(leaf.slots) == 1:
            aggregates.append(F.sum(F.when(mine, part)).alias(f"s{leaf.number}"))
            continue
        for j in range(len(leaf.slots)):
            aggregates.append(F.flatten(F.collect_list(F.when(mine & (F.col("slot") == j), F.col("positions")))).alias(f"p{leaf.number}_{j}"))
        aggregates += [F.max(F.when(mine, F.col("dl"))).alias(f"d{leaf.number}")]
    hits = joined.groupBy(*KEYS).agg(*aggregates)
    for leaf in leaves:
        if len(leaf.slots) > 1:
            hits = hits.withColumn(f"s{leaf.number}", _phrase_score(index, leaf, fields, df_of))
    return hits


def phrase_frequency(leaf: Leaf) -> Column:
    """How often the phrase occurs: in order side by side, or, for nearness, from how many places a span begins that holds
    all words in any order with at most ``slop`` others."""
    n = len(leaf.slots)
    places = [F.col(f"p{leaf.number}_{j}") for j in range(n)]
    if not leaf.near:
        first = places[0]
        for j in range(1, n):
            first = F.array_intersect(first, _moved(places[j], j))
        return F.size(F.array_distinct(first))
    width = leaf.slop + n - 1
    starts = F.array_distinct(F.flatten(F.array(*places)))

    def holds(a: Column) -> Column:
        return reduce(lambda x, y: x & y, [F.exists(p, lambda x: (x >= a) & (x <= a + width)) for p in places])

    return F.size(F.filter(starts, holds))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _phrase_score(index, leaf: Leaf, fields: dict, df_of: dict) -> Column:
    n, mean = fields[leaf.field]
    idf = sum(scoring.idf_value(n, max((df_of.get((leaf.field, t), 0) for t in slot), default=0)) for slot in leaf.slots)
    tf = phrase_frequency(leaf)
    dl = F.col(f"d{leaf.number}")
    score = leaf.share * idf * tf * (scoring.K1 + 1) / (tf + scoring.K1 * (1 - scoring.B + scoring.B * dl / mean))
    return F.when(tf > 0, score)
