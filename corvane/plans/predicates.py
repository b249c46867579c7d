"""Predicates on metadata: a small language compiled to Column conditions.

``Year >= 2020 AND (Type == "note" OR "draft" in tags) AND NOT Project ~~ "x*"``. A missing
value makes every comparison false, also negative ones; only NOT turns that around. Types are
strict: numbers compare with numbers, dates with dates, strings with strings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.errors import QuerySyntaxError
from corvane.functions.patterns import glob_to_regex, path_glob_to_regex

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
  | (?P<date>\d{4}-\d{2}-\d{2})
  | (?P<number>-?\d[\d_]*(?:\.\d+)?)
  | (?P<op>==|!=|<=|>=|~~|<|>)
  | (?P<mark>[()\[\],])
  | (?P<word>[^\s()\[\],<>=!~"']+)
)""",
    re.X,
)


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Holds:
    """A value in a list-valued field, or (``among``) a field's value in a list."""

    field: str
    values: tuple
    among: bool
    negative: bool


@dataclass(frozen=True)
class Negation:
    part: object


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


class _Reader:
    def __init__(self, text: str):
        self.source, self.tokens, self.at = text, [], 0
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise QuerySyntaxError(f"cannot read a filter from {text[at:at + 10]!r}", text)
            kind = m.lastgroup
            self.tokens.append((kind, m[kind]))
            at = m.end()

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1].upper() in values and self.tokens[self.at][0] != "string"

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise QuerySyntaxError("a filter ends too early", self.source)
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self):
        parts = [self.both()]
        while self.peek("OR"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def both(self):
        parts = [self.one()]
        while self.peek("AND"):
            self.take()
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def one(self):
        if self.peek("NOT"):
            self.take()
            return Negation(self.one())
        if self.peek("("):
            self.take()
            inner = self.either()
            if not self.peek(")"):
                raise QuerySyntaxError("a ( of a filter has no )", self.source)
            self.take()
            return inner
        kind, first = self.take()
        if kind in ("string", "number", "date") or first.lower() in ("true", "false", "null"):
            negative = self._in()
            return Holds(self._name(), (literal(kind, first),), False, negative)
        if kind != "word":
            raise QuerySyntaxError(f"a filter cannot begin with {first!r}", self.source)
        name = first
        while self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and not self.peek("IN", "NOT", "AND", "OR"):
            name += " " + self.take()[1]
        if self.peek("IN", "NOT"):
            negative = self._in()
            return Holds(name, self._list(), True, negative)
        kind, op = self.take()
        if kind != "op":
            raise QuerySyntaxError(f"after {name!r} a comparison should stand", self.source)
        return Compare(name, op, literal(*self.take()))

    def _in(self) -> bool:
        negative = self.peek("NOT")
        if negative:
            self.take()
        if not self.peek("IN"):
            raise QuerySyntaxError("after a value in should stand", self.source)
        self.take()
        return negative

    def _name(self) -> str:
        name = [self.take()[1]]
        while self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and not self.peek("AND", "OR"):
            name.append(self.take()[1])
        return " ".join(name)

    def _list(self) -> tuple:
        if not self.peek("["):
            raise QuerySyntaxError("after in a list should stand", self.source)
        self.take()
        out = []
        while not self.peek("]"):
            out.append(literal(*self.take()))
            if self.peek(","):
                self.take()
        self.take()
        return tuple(out)


def literal(kind: str, text: str):
    if kind == "string":
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    if kind == "date":
        return date.fromisoformat(text)
    if kind == "number":
        return float(text.replace("_", "")) if "." in text else int(text.replace("_", ""))
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() == "null":
        return None
    raise QuerySyntaxError(f"{text!r} is no value", text)


def parse(text: str):
    reader = _Reader(text)
    tree = reader.either()
    if reader.at < len(reader.tokens):
        raise QuerySyntaxError(f"a filter has {reader.tokens[reader.at][1]!r} too much", text)
    return tree


def fields(tree) -> set[str]:
    if isinstance(tree, (Both, Either)):
        return set().union(*map(fields, tree.parts))
    return fields(tree.part) if isinstance(tree, Negation) else {tree.field}


def column(tree, schema: T.StructType) -> Column:
    """The condition, never null. Fields are columns of ``schema``, by name without regard to case; others are missing."""
    names = {f.name.lower(): f for f in schema.fields}

    def one(node) -> Column:
        if isinstance(node, Negation):
            return ~one(node.part)
        if isinstance(node, (Both, Either)):
            out = one(node.parts[0])
            for p in node.parts[1:]:
                out = out & one(p) if isinstance(node, Both) else out | one(p)
            return out
        f = names.get(node.field.lower())
        if f is None:
            return F.lit(False)
        x = F.col(f"`{f.name}`")
        is_list = isinstance(f.dataType, T.ArrayType)
        kind = f.dataType.elementType if is_list else f.dataType
        if isinstance(node, Compare):
            test = _comparison(node, kind, f.name)
            if test is None:
                return F.lit(False)
            if is_list:
                inner = F.exists(x, test)
                return F.coalesce(x.isNotNull() & (~F.exists(x, _comparison(Compare(node.field, "==", node.value), kind, f.name)) if node.op == "!=" else inner), F.lit(False))
            return F.coalesce(test(x), F.lit(False))
        good = [v for v in node.values if _comparable(v, kind)]
        there = F.lit(False)
        for v in good:
            there = there | (F.coalesce(F.array_contains(x, F.lit(v)), F.lit(False)) if is_list else x == F.lit(v))
        return F.coalesce(x.isNotNull() & (~there if node.negative else there), F.lit(False))

    return one(tree)


def _comparable(value: object, kind: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, date):
        return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return isinstance(value, str) and isinstance(kind, T.StringType)


def _comparison(node: Compare, kind: T.DataType, name: str):
    v, op = node.value, node.op
    if v is None:
        return None
    if op == "~~":
        if not isinstance(v, str) or not isinstance(kind, T.StringType):
            return None
        pattern = path_glob_to_regex(v) if name.lower() in ("path", "file.path") else glob_to_regex(v)
        return lambda x: x.rlike(pattern)
    if not _comparable(v, kind):
        return (lambda x: x.isNotNull()) if op == "!=" else None
    if op in ("<", ">", "<=", ">=") and isinstance(v, (str, bool)):
        return None
    return {"==": lambda x: x == F.lit(v), "!=": lambda x: x != F.lit(v), "<": lambda x: x < F.lit(v), ">": lambda x: x > F.lit(v), "<=": lambda x: x <= F.lit(v), ">=": lambda x: x >= F.lit(v)}[op]


def text(tree) -> str:
    """The filter written out again; reading it gives an equal tree."""
    if isinstance(tree, Negation):
        return f"NOT ({text(tree.part)})"
    if isinstance(tree, (Both, Either)):
        return (" AND " if isinstance(tree, Both) else " OR ").join(f"({text(p)})" if isinstance(p, (Both, Either)) else text(p) for p in tree.parts)
    if isinstance(tree, Compare):
        return f"{tree.field} {tree.op} {_written(tree.value)}"
    no = "not " * tree.negative
    if tree.among:
        return f"{tree.field} {no}in [{', '.join(map(_written, tree.values))}]"
    return f"{_written(tree.values[0])} {no}in {tree.field}"


def _written(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return str(v)


@dataclass(frozen=True)
class Rule:
    """A condition of an index: it holds for chunks of other kinds, and for unknown facts."""

    fact: str
    test: object  # Column -> Column
    kinds: tuple[str, ...] = ()

    def column(self) -> Column:
        passes = F.coalesce(self.test(F.col(self.fact)), F.lit(True))
        return passes | ~F.col("kind").isin(*self.kinds) if self.kinds else passes


def contradictory(low, high) -> bool:
    """Whether no value lies between two bounds."""
    return low is not None and high is not None and low > high
