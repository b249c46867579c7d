"""Kinds of files: suffixes, categories and what reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of each kind, by category.
CATEGORIES: dict[str, dict[str, str]] = {
    "note": {"md": "md markdown mdx", "txt": "txt text log rst"},
    "web": {"html": "html htm xhtml"},
    "book": {"pdf": "pdf", "epub": "epub"},
    "document": {"docx": "docx", "odt": "odt"},
    "slides": {"pptx": "pptx", "odp": "odp"},
    "sheet": {"csv": "csv", "tsv": "tsv", "ods": "ods"},
    "data": {"json": "json jsonl", "yaml": "yaml yml", "toml": "toml", "xml": "xml", "ini": "ini cfg conf"},
    "notebook": {"ipynb": "ipynb"},
    "code": {
        "python": "py pyi", "javascript": "js mjs cjs jsx", "typescript": "ts tsx", "java": "java", "kotlin": "kt kts", "scala": "scala", "c": "c h", "cpp": "cc cpp cxx hpp", "csharp": "cs", "go": "go", "rust": "rs",
        "ruby": "rb", "php": "php", "swift": "swift", "shell": "sh bash zsh", "sql": "sql", "r": "r", "julia": "jl", "lua": "lua", "perl": "pl pm", "haskell": "hs", "css": "css scss",
    },
}
KIND_OF_SUFFIX = {s: kind for kinds in CATEGORIES.values() for kind, suffixes in kinds.items() for s in suffixes.split()}
CATEGORY_OF_KIND = {kind: c for c, kinds in CATEGORIES.items() for kind in kinds}
NOTE_KINDS = tuple(CATEGORIES["note"])


def kinds_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, k, CATEGORY_OF_KIND[k]) for s, k in sorted(KIND_OF_SUFFIX.items())], "suffix string, kind string, category string")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    """Kind by suffix; null for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in KIND_OF_SUFFIX.items() for x in pair])
    return F.try_element_at(table, suffix(path))


def category(kind_column: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CATEGORY_OF_KIND.items() for x in pair])
    return F.try_element_at(table, kind_column)


def split_type_globs(globs: list[str]) -> tuple[list[str], list[str]]:
    """Kinds all of whose suffixes are named as ``*.suffix``, and the globs that remain."""
    named = {g[2:].lower() for g in globs if g.startswith("*.") and "/" not in g}
    whole = [k for kinds in CATEGORIES.values() for k, s in kinds.items() if set(s.split()) <= named]
    used = {s for k in whole for s in CATEGORIES[CATEGORY_OF_KIND[k]][k].split()}
    return whole, [g for g in globs if not (g.startswith("*.") and g[2:].lower() in used)]
