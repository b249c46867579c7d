"""Facts of files as columns that a rule can name: ``file.size > 1000 AND file.kind == "md"``.

What is not known of a file is null, and no comparison holds for it; a name that is no fact is an error before anything runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.errors import QuerySyntaxError
from corvane.plans import predicates
from corvane.sources import kinds

#: The names.
FACTS = tuple(f"file.{x}" for x in "path name ext kind category size created modified hidden tags.os tags.frontmatter tags.all".split())


def with_facts(files: DataFrame) -> DataFrame:
    """``files`` with a column for each fact. It needs ``path``; ``size``, ``created``, ``mtime``, ``tags_os`` and ``tags_fm`` are used if
    they are there. Times are seconds, 0 for unknown."""
    path, have = F.col("path"), set(files.columns)
    none = F.array().cast("array<string>")

    def when(column: str):
        return F.when(F.col(column) > 0, F.to_date(F.timestamp_seconds(column))) if column in have else F.lit(None).cast("date")

    kind = kinds.kind(path)
    os, fm = (F.col(c) if c in have else F.lit(None).cast("array<string>") for c in ("tags_os", "tags_fm"))
    made = {
        "path": path,
        "name": F.regexp_extract(path, r"([^/]*)$", 1),
        "ext": kinds.suffix(path),
        "kind": kind,
        "category": kinds.category(kind),
        "size": F.col("size").cast("long") if "size" in have else F.lit(None).cast("long"),
        "created": when("created"),
        "modified": when("mtime"),
        "hidden": path.rlike(r"(?:^|/)\.[^/.]"),
        "tags.os": os,
        "tags.frontmatter": fm,
        "tags.all": F.when(os.isNotNull() | fm.isNotNull(), F.array_union(F.coalesce(os, none), F.coalesce(fm, none))),
    }
    return files.select("*", *(c.alias(f"file.{n}") for n, c in made.items()))


def passing(files: DataFrame, rule: str) -> DataFrame:
    """Files that a rule admits, with their own columns only."""
    tree = predicates.parse(rule)
    for name in predicates.fields(tree):
        if name.lower().startswith("file.") and name.lower() not in FACTS:
            raise QuerySyntaxError(f"no fact {name!r}", rule)
    rows = with_facts(files)
    return rows.filter(predicates.column(tree, rows.schema)).select(*files.columns)
