"""Text functions as Column expressions, and their twins for query words on the driver."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.stem import stem

MOST_TOKEN_BYTES = 40
TOKEN = r"([\p{L}\p{N}]+)"

#: Words that carry no meaning on their own in a bag of words.
STOPWORDS = frozenset("a an and are as at be but by for from had has have he her his i if in into is it its no not of on or she such that the their then there these they this to was we were will with you".split())

#: Compatibility forms that the canonical text writes out.
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_FULL_WIDTH = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94) if chr(0x21 + k).isalnum()}
_QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"', "′": "'", "″": '"'}
_KEPT_FORMATS = "‌‍"

#: Accented Latin letters with one plain letter, found from their decompositions.
ACCENTS = {c: d[0] for k in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", c := chr(k))) != c and d[0].isascii()} | {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ħ": "h", "ı": "i"}
_WIDE_FOLDS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}


def canonical(text: Column) -> Column:
    """Line ends to line feeds, other breaks to spaces, controls and formats away (tab, line feed and
    joiners stay), ligatures and full-width letters written out. Composition is ``compose``'s."""
    x = F.regexp_replace(text, r"\r\n?", "\n")
    x = F.regexp_replace(x, "[\\x0B\\x0C\\x85  ]", " ")
    x = F.regexp_replace(x, r"(?![\t\n\x{200C}\x{200D}])[\p{Cc}\p{Cf}]", "")
    x = F.translate(x, "".join(_FULL_WIDTH), "".join(_FULL_WIDTH.values()))
    for form, letters in _LIGATURES.items():
        x = F.replace(x, F.lit(form), F.lit(letters))
    return x


def canonical_text(text: str) -> str:
    """The driver's twin of ``canonical``, composed."""
    x = re.sub(r"\r\n?", "\n", text)
    x = re.sub("[\x0b\x0c\x85  ]", " ", x)
    x = "".join(c for c in x if c in "\t\n" + _KEPT_FORMATS or unicodedata.category(c) not in ("Cc", "Cf"))
    return unicodedata.normalize("NFC", x.translate(str.maketrans(_FULL_WIDTH | _LIGATURES)))


def fold_text(text: str) -> str:
    return canonical_text(text).casefold()


def quote_view(text: Column) -> Column:
    """Typographic quotes as ASCII ones, length unchanged."""
    return F.translate(text, "".join(_QUOTES), "".join(_QUOTES.values()))


def quote_view_text(text: str) -> str:
    return text.translate(str.maketrans(_QUOTES))


def is_apostrophe(text: str, at: int) -> bool:
    """A quote between two letters or digits."""
    return 0 < at < len(text) - 1 and text[at] in "'’" and text[at - 1].isalnum() and text[at + 1].isalnum()


def fold_accents(text: Column) -> Column:
    x = F.translate(text, "".join(ACCENTS), "".join(ACCENTS.values()))
    for letter, written in _WIDE_FOLDS.items():
        x = F.replace(x, F.lit(letter), F.lit(written))
    return x


def fold_accents_text(text: str) -> str:
    return text.translate(str.maketrans(ACCENTS | _WIDE_FOLDS))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; very long ones are left out."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 1), lambda w: F.octet_length(w) <= MOST_TOKEN_BYTES)


def words_of(text: str) -> list[str]:
    found = re.findall(r"[^\W_]+", text.lower())
    return [w for w in found if len(w.encode()) <= MOST_TOKEN_BYTES]


def stems_of(text: str) -> list[str]:
    """The analysed words of a query: folded and stemmed."""
    return [stem(fold_accents_text(w)) for w in words_of(text)]


def index_token(word: str) -> str:
    return "".join(stems_of(word)) or word.lower()


def word_token(word: str) -> str:
    return "".join(words_of(word)) or word.lower()


def strip_stopwords(query: str) -> str:
    """A bag of words without stop words; a query with other syntax, or of stop words only, stays."""
    if re.search(r'["\'()\[\]{}:*?~^/+|\\]|(?:^|\s)-|\b(?:AND|OR|NOT|NEAR)\b', query):
        return query
    kept = [w for w in query.split() if w.strip(".,;!").lower() not in STOPWORDS]
    return " ".join(kept) if kept else query


def is_all_stopwords(query: str) -> bool:
    found = query.split()
    return bool(found) and all(w.strip(".,;!?").lower() in STOPWORDS for w in found)


def decode(data: bytes) -> str:
    """Bytes as text: marks of UTF-16 and UTF-32 first, then UTF-8, then the Windows code page if
    more than half of the long bytes are no UTF-8."""
    for mark, name in ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    text = data.decode("utf-8-sig", "replace")
    bad = text.count("�")
    good = sum(1 for c in text if c > "\x7f") - bad
    return data.decode("cp1252", "replace") if bad > good else text


def display_line(text: Column) -> Column:
    """One safe line: white space joined, controls and direction marks away."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[\p{Cc}\x{202A}-\x{202E}\x{2066}-\x{2069}]", ""))


def cell_width(c: str) -> int:
    return 0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1


def fit(text: str, cells: int) -> str:
    """The text cut to a number of terminal cells, with an ellipsis if it was longer."""
    if sum(map(cell_width, text)) <= cells:
        return text
    out, used = [], 0
    for c in text:
        if used + cell_width(c) > cells - 1:
            break
        out.append(c)
        used += cell_width(c)
    return "".join(out) + "…" if cells > 0 else ""
