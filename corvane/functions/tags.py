"""Tags as Column expressions: normal form, ancestors and selections."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS, MOST_TAGS = 128, 256


def normal(tag: Column) -> Column:
    """Without leading marks, white space joined, in lower case, and bounded."""
    x = F.trim(F.regexp_replace(F.trim(tag), r"^#+", ""))
    return F.substring(F.lower(F.regexp_replace(x, r"\s+", " ")), 1, MOST_CHARS)


def unlinked(tag: Column) -> Column:
    """The label of a wiki link, or the tag itself."""
    inner = F.regexp_extract(tag, r"^\s*\[\[(.*)\]\]\s*$", 1)
    label = F.when(F.contains(inner, F.lit("|")), F.element_at(F.split(inner, r"\|"), -1)).otherwise(inner)
    return F.when(inner != "", label).otherwise(tag)


def ancestors(tag: Column) -> Column:
    """a/b/c: a, a/b and a/b/c."""
    parts = F.filter(F.split(tag, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def expanded(tags: Column) -> Column:
    """Distinct normal tags with all their ancestors, at most ``MOST_TAGS``."""
    cleaned = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: normal(unlinked(t))), lambda t: t != "")
    return F.slice(F.array_distinct(F.flatten(F.transform(cleaned, ancestors))), 1, MOST_TAGS)


def split_tags(text: Column) -> Column:
    return F.transform(F.split(text, ","), F.trim)


@dataclass(frozen=True)
class TagFilter:
    """Tags that must (all or any) and must not be there; a value counts in whatever provenance it has."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    all_of: bool = False

    def column(self, *tags: Column) -> Column:
        every = F.flatten(F.array(*(F.coalesce(t, F.array().cast("array<string>")) for t in tags)))
        out = F.lit(True)
        if self.include:
            each = [F.array_contains(every, t) for t in self.include]
            joined = each[0]
            for e in each[1:]:
                joined = joined & e if self.all_of else joined | e
            out = joined
        for t in self.exclude:
            out = out & ~F.array_contains(every, t)
        return out


def source_selection(raw: list[str], sources: list[str]) -> dict[str, frozenset[str]]:
    """Tags that name no source are claimed for every one; without tags there is no filter."""
    found = ((re.sub(r"\s+", " ", re.sub(r"^#+", "", t.strip())).strip().lower())[:MOST_CHARS] for t in raw)
    tags = frozenset(t for t in found if t)
    return {s: tags for s in sources} if tags else {}
