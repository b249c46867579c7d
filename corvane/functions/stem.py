"""The English stemmer known as Porter2, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed values of the algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
_KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_ENDS_1B = ("eed", "eedly", "ed", "edly", "ing", "ingly")
_ENDS_2, _ENDS_3, _ENDS_4 = (*_STEP2, "ogi", "li"), (*_STEP3, "ative"), (*_STEP4, "ion")
_V = "[aeiouy]"
_VOWEL, _VOWEL_S, _VOWEL_OTHER = re.compile(_V), re.compile(f"{_V}.+s$"), re.compile(f"{_V}[^aeiouy]")
_SHORT_END = re.compile(f"[^aeiouy]{_V}[^aeiouywxY]$")
_HEAD, _CONSONANT_Y, _OWNER = re.compile("gener|commun|arsen"), re.compile("^y|(?<=[aeiouy])y"), re.compile("('s'|'s|')$")


def _regions(word: str) -> tuple[int, int]:
    head = _HEAD.match(word)
    first = head.end() if head else (m.end() if (m := _VOWEL_OTHER.search(word)) else len(word))
    second = m.end() if (m := _VOWEL_OTHER.search(word, first)) else len(word)
    return first, second


def _short_end(word: str) -> bool:
    return bool(_SHORT_END.search(word) or _VOWEL_OTHER.fullmatch(word))


def _longest(word: str, ends: tuple[str, ...]) -> str:
    return max((e for e in ends if word.endswith(e)), key=len) if word.endswith(ends) else ""


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    if word in _KEPT:
        return word
    w = word.lstrip("'")
    if "y" in w:
        w = _CONSONANT_Y.sub("Y", w)
    r1, r2 = _regions(w)
    if "'" in w:
        w = _OWNER.sub("", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL_S.search(w):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w
    # 1b
    end = _longest(w, _ENDS_1B)
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2
    end = _longest(w, _ENDS_2)
    at = len(w) - len(end)
    if end and at >= r1:
        if end in _STEP2:
            w = w[:at] + _STEP2[end]
        elif end == "ogi" and w[:at].endswith("l"):
            w = w[:-1]
        elif end == "li" and at and w[at - 1] in "cdeghkmnrt":
            w = w[:at]
    # 3
    end = _longest(w, _ENDS_3)
    at = len(w) - len(end)
    if end and at >= r1:
        if end in _STEP3:
            w = w[:at] + _STEP3[end]
        elif at >= r2:
            w = w[:at]
    # 4
    end = _longest(w, _ENDS_4)
    at = len(w) - len(end)
    if end and at >= r2 and (end != "ion" or w[:at].endswith(("s", "t"))):
        w = w[:at]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
