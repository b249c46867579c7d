"""Widening of queries: synonyms, numbers, compounds, respellings and fuzzy words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.edits import automatic_reach, one_edit
from corvane.functions.text import STOPWORDS, words_of
from corvane.plans import language as q

#: Thresholds of respelling.
LEAST_LETTERS, MOST_OPTIONS, LEAST_SHARE, RARE_CHUNKS, RARE_TIMES = 3, 3, 0.05, 20, 50
COMPOUND_LETTERS, COMPOUND_PART = 5, 2


@dataclass
class Synonyms:
    """Groups of terms that stand for each other, both ways; groups that share a term are one."""

    groups: list[frozenset[str]] = field(default_factory=list)

    @classmethod
    def of(cls, groups) -> "Synonyms":
        merged: list[set[str]] = []
        for g in groups:
            new = {_plain(t) for t in g if _plain(t)}
            touching = [m for m in merged if m & new]
            for m in touching:
                new |= m
                merged.remove(m)
            if len(new) > 1:
                merged.append(new)
        return cls([frozenset(m) for m in merged])

    @classmethod
    def read(cls, toml_text: str) -> "Synonyms":
        """Groups of a TOML document: ``groups = [["a", "b"], ...]``."""
        import tomllib

        return cls.of(tomllib.loads(toml_text).get("groups", []))

    def merged(self, other: "Synonyms") -> "Synonyms":
        return Synonyms.of([*self.groups, *other.groups])

    def of_term(self, term: str) -> list[str]:
        return sorted({t for g in self.groups if _plain(term) in g for t in g} - {_plain(term)})

    def expand(self, text: str):
        """A bag of words as a tree in which the longest known runs are sums of their synonyms, the typed form
        first; None if nothing changes. A quoted word never expands."""
        if not q.is_bag_of_words(text):
            return None
        found = words_of(text)
        longest = max((len(t.split()) for g in self.groups for t in g), default=1)
        parts, i, changed = [], 0, False
        while i < len(found):
            for n in range(min(longest, len(found) - i), 0, -1):
                run = " ".join(found[i : i + n])
                if others := self.of_term(run):
                    parts.append(q.Or(tuple(_leaf(t) for t in [run, *others])))
                    changed = True
                    i += n
                    break
            else:
                parts.append(q.Term(found[i]))
                i += 1
        if not changed:
            return None
        return parts[0] if len(parts) == 1 else q.Or(tuple(parts))


def _plain(term: str) -> str:
    return " ".join(words_of(term.replace("-", " ")))


def _leaf(term: str):
    return q.Term(term) if " " not in term else q.Phrase(term)


def number_groups() -> list[set[str]]:
    """Numbers in digits and words: 0 to 20, tens, hundred and thousand; ordinals apart."""
    small = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    tens = {30: "thirty", 40: "forty", 50: "fifty", 60: "sixty", 70: "seventy", 80: "eighty", 90: "ninety", 100: "hundred", 1000: "thousand"}
    cardinal = {**dict(enumerate(small)), **tens}
    odd = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
    out = [{str(n), w} for n, w in cardinal.items()]
    for n, w in cardinal.items():
        if n:
            ordinal = odd.get(w) or (w[:-1] + "ieth" if w.endswith("y") else w + "th")
            end = {1: "st", 2: "nd", 3: "rd"}.get(n % 10 if n % 100 not in (11, 12, 13) else 0, "th")
            out.append({f"{n}{end}", ordinal})
    return out


def compounds(word: str) -> list[str]:
    """Other spellings of one word: joined, hyphens as spaces, or split into two parts anywhere."""
    if "-" in word:
        parts = [p for p in word.lower().split("-") if p]
        return ["".join(parts), " ".join(parts)] if len(parts) > 1 else []
    if len(word) < COMPOUND_LETTERS or not word.isalpha():
        return []
    w = word.lower()
    return [f"{w[:i]} {w[i:]}" for i in range(COMPOUND_PART, len(w) - COMPOUND_PART + 1)]


def compound_tree(word: str):
    found = compounds(word)
    return q.Or(tuple(_leaf(t) for t in found)) if found else None


def fuzzy_tree(tree, compiler, shortest: int = 4):
    """Every plain word as a sum of its near terms, all words needed; None if no word may be widened, or one has no near term."""
    found = []
    reaches = False
    for w in q.wanted_words(tree):
        most = automatic_reach(w, shortest)
        reaches = reaches or most > 0
        terms = compiler.fuzzy_terms(w, most) if most else [w]
        if not terms:
            return None
        found.append(q.Or(tuple(q.Term(t) for t in terms)) if len(terms) > 1 else q.Term(terms[0]))
    if not reaches or not found:
        return None
    return found[0] if len(found) == 1 else q.And(tuple(found))


def corrections(terms: DataFrame, words: list[str]) -> DataFrame:
    """(word, term, df, place): dictionary terms one edit from words that no chunk has, at most three each, none under a twentieth of the best.

    A word that is one edit from a stop word is left alone."""
    spark = terms.sparkSession
    asked = [w for w in dict.fromkeys(words) if w.isalpha() and len(w) >= LEAST_LETTERS and not (one_edit(w) & STOPWORDS)]
    candidates = [(w, c) for w in asked for c in sorted(one_edit(w))]
    # Bounded by the query: some sixty candidates a letter.
    rows = F.broadcast(spark.createDataFrame(candidates, "word string, term string"))
    known = [r["term"] for r in terms.filter(F.col("term").isin(asked or [""])).select("term").collect()]
    near = terms.join(rows, "term").filter(~F.col("word").isin(known) if known else F.lit(True))
    order = Window.partitionBy("word").orderBy(F.desc("df"), "term")
    near = near.withColumn("place", F.row_number().over(order)).withColumn("best", F.max("df").over(Window.partitionBy("word")))
    return near.filter((F.col("place") <= MOST_OPTIONS) & (F.col("df") >= LEAST_SHARE * F.col("best"))).select("word", "term", "df", "place")


def rare_spellings(terms: DataFrame, words: list[str]) -> DataFrame:
    """(word, df, term, term_df): words in a few chunks with a neighbour that is very much commoner."""
    spark = terms.sparkSession
    asked = terms.filter(F.col("term").isin(list(dict.fromkeys(words)) or [""]) & F.col("df").between(1, RARE_CHUNKS)).select(F.col("term").alias("word"), F.col("df").alias("own"))
    rows = spark.createDataFrame([(w, c) for w in dict.fromkeys(words) for c in sorted(one_edit(w))], "word string, term string")
    near = terms.join(F.broadcast(rows), "term").join(F.broadcast(asked), "word").filter(F.col("df") >= RARE_TIMES * F.col("own"))
    order = Window.partitionBy("word").orderBy(F.desc("df"), "term")
    return near.withColumn("place", F.row_number().over(order)).filter("place = 1").select("word", F.col("own").alias("df"), "term", F.col("df").alias("term_df"))


def respelt(text: str, chosen: dict[str, str]) -> str:
    """A query with plain words replaced; everything else as typed."""
    if not q.is_bag_of_words(text):
        return text
    return re.sub(r"[^\W_]+", lambda m: chosen.get(m[0].lower(), m[0]), text)


def notice(chosen: dict[str, str]) -> str:
    return ", ".join(f"{b} (for {a})" for a, b in sorted(chosen.items()))


def closest(value: str, known: list[str], most: int = 3) -> list[str]:
    """Known values nearest to one that is not: the closest distance only, within two edits."""
    from corvane.functions.edits import osa_within

    found = [(osa_within(value.lower(), k.lower(), 2), k) for k in known]
    best = min((d for d, _ in found), default=3)
    return sorted(k for d, k in found if d == best and d <= 2)[:most]
