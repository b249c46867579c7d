"""Errors a query can be answered with."""

from __future__ import annotations


class QueryError(ValueError):
    """Anything wrong with a query."""


class QuerySyntaxError(QueryError):
    def __init__(self, message: str, query: str = ""):
        super().__init__(message)
        self.query = query


class QueryTooLargeError(QueryError):
    pass


class UnknownValueError(QueryError):
    """A filter names a value that no row has; ``near`` are the closest that exist."""

    def __init__(self, field: str, value: str, near: list[str]):
        self.field, self.value, self.near = field, value, near
        super().__init__(f"{field}: no {value!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))


class SchemaVersionError(RuntimeError):
    """An index was written by another version."""
