"""Stored forms: metadata with dates, blocks, marks where a chunk was cut, membership tokens, digests."""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The envelope of a date, the separator of a membership, and the labels of marks.
TYPE, VALUE, DATE = "__type__", "value", "date"
MEMBER_SEPARATOR = "\x1f"
ABOVE, BELOW = "continued-above", "continues-below"
_MARK = re.compile(r'\[(continued-above|continues-below)\]: <> "([^"\n]*)"')


def encode_meta(meta: dict) -> str:
    """Metadata as JSON; a date stands in an envelope, as JSON has none. Other values that JSON lacks raise TypeError."""

    def envelope(v: object) -> dict:
        if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
            return {TYPE: DATE, VALUE: v.isoformat()}
        raise TypeError(f"metadata holds {type(v).__name__}")

    return json.dumps(meta, default=envelope, ensure_ascii=False)


def decode_meta(text: str | None) -> dict:
    """Metadata again, with its dates. The outermost mapping is never an envelope, whatever its keys; nothing is an empty mapping."""

    def restored(v: object) -> object:
        if isinstance(v, list):
            return [restored(x) for x in v]
        if isinstance(v, dict) and set(v) == {TYPE, VALUE} and v[TYPE] == DATE:
            try:
                return dt.date.fromisoformat(v[VALUE])
            except (TypeError, ValueError):
                return v
        return v

    return {k: restored(v) for k, v in json.loads(text).items()} if text else {}


BLOCKS = "array<struct<kind:string,text:string>>"


def encode_blocks(blocks: Column) -> Column:
    """An array of (kind, text) as JSON."""
    return F.to_json(blocks)


def decode_blocks(text: Column) -> Column:
    return F.from_json(text, BLOCKS)


def with_seams(body: str, above: list[str] | None = None, below: list[str] | None = None) -> str:
    """A chunk's text marked as going on from the one above and into the one below; the lists name the containers that are open, from
    the outermost (``quote``, ``list``, ``item``; ``code`` for a fence). A mark is a link definition, which shows nothing."""
    top = "" if above is None else f'[{ABOVE}]: <> "{" ".join(above)}"\n'
    end = "" if below is None else f'\n\n[{BELOW}]: <> "{" ".join(below)}"'
    return top + body + end


def read_seams(text: str) -> tuple[list[str] | None, list[str] | None, str]:
    """The containers open above and below, and the text without marks."""
    lines, above, below = text.split("\n"), None, None
    if (m := _MARK.fullmatch(lines[0])) and m[1] == ABOVE:
        above, lines = m[2].split(), lines[1:]
    if lines and (m := _MARK.fullmatch(lines[-1])) and m[1] == BELOW:
        below, lines = m[2].split(), lines[:-1]
        while lines and not lines[-1]:
            lines.pop()
    return above, below, "\n".join(lines)


def membership_token(collection: Column, source: Column) -> Column:
    """One exact term for a file's membership in a collection by a source."""
    return F.concat(collection, F.lit(MEMBER_SEPARATOR), source)


def parse_membership_token(token: Column) -> Column:
    """(collection, source) of a token."""
    at = F.instr(token, F.lit(MEMBER_SEPARATOR))
    return F.struct(F.when(at > 0, F.substring(token, F.lit(1), at - 1)).otherwise(token).alias("collection"), F.when(at > 0, F.substring(token, at + 1, F.length(token))).otherwise(F.lit("")).alias("source"))


def collections_of(tokens: Column) -> Column:
    """The distinct collections of an array of tokens."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: parse_membership_token(t)["collection"])))


def stored_digest(*parts: Column) -> Column:
    """A digest of texts in which each one's length stands before it, so that no two lists of parts look alike."""
    each = [F.concat(F.lpad(F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), 12, "0"), F.coalesce(p, F.lit(""))) for p in parts]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def shown_text(body: Column, repeated: Column) -> Column:
    """A text without its last ``repeated`` characters, which the next chunk shows."""
    return F.substring(body, F.lit(1), F.greatest(F.length(body) - repeated, F.lit(0)))
