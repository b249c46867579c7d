"""Edit distances between words."""

from __future__ import annotations

import string


def levenshtein_within(a: str, b: str, most: int) -> int:
    """The distance, or ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
        before = row
    return min(before[-1], most + 1)


def osa_within(a: str, b: str, most: int) -> int:
    """Optimal string alignment: insertions, deletions, substitutions and swaps of neighbours,
    no letter edited twice; or ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, before = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most and min(before) > most:
            return most + 1
        older, before = before, row
    return min(before[-1], most + 1)


def automatic_distance(word: str) -> int:
    """0, 1 or 2 edits by length."""
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


def automatic_reach(word: str, shortest: int = 4) -> int:
    """Edits that widening allows on its own: one, and none in short words or words with digits."""
    if len(word) < shortest or any(c.isdigit() for c in word):
        return 0
    return min(1, automatic_distance(word))


def one_edit(word: str, letters: str = string.ascii_lowercase) -> set[str]:
    """All words one insertion, deletion, substitution or swap away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return (
        {a + b[1:] for a, b in cuts if b}
        | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        | {a + c + b[1:] for a, b in cuts if b for c in letters}
        | {a + c + b for a, b in cuts for c in letters}
    ) - {word}


def leading_edits(word: str, letters: str = string.ascii_lowercase) -> set[str]:
    """One edit at the front, which a shared first letter would miss."""
    if not word:
        return set()
    out = {word[1:], *(c + word[1:] for c in letters), *(c + word for c in letters)}
    if len(word) > 1:
        out.add(word[1] + word[0] + word[2:])
    return out - {word, ""}


def fuzzy_reaches(typed: str, word: str, most: int) -> bool:
    """Same first letter within the distance, or one edit at the front."""
    if typed[:1] == word[:1]:
        return osa_within(typed, word, most) <= most
    return most > 0 and word in leading_edits(typed)


def aligned(typed: str, word: str) -> list[bool]:
    """For each letter of ``word``, whether a shortest alignment with ``typed`` keeps it."""
    n, m = len(typed), len(word)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (typed[i - 1] != word[j - 1]))
    kept, i, j = [False] * m, n, m
    while i and j:
        if cost[i][j] == cost[i - 1][j - 1] + (typed[i - 1] != word[j - 1]):
            kept[j - 1] = typed[i - 1] == word[j - 1]
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return kept


def typed_fuzzy_reaches(stem: str, word: str, typed_stem: str, typed: str, most: int) -> bool:
    """Whether a typed ``word~N`` admits a token: its stem is near the typed one's, or its word near the word as typed."""
    return fuzzy_reaches(typed_stem, stem, most) or bool(word) and fuzzy_reaches(typed, word, most)


def closest_typed(word: str, typed: list[str]) -> str | None:
    """The first of the typed words with the smallest distance from a word."""
    return min(typed, key=lambda t: levenshtein_within(t, word, max(len(t), len(word))), default=None)
