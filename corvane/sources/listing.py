"""Files of folders as rows, and the claims of sources on them."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.patterns import IgnoreRules, path_glob_to_regex
from corvane.sources import kinds

#: Folders and files that are never content.
JUNK_FOLDERS = (".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", ".cache", ".idea")
JUNK_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")


@dataclass(frozen=True)
class Source:
    """A folder and what is taken from it."""

    collection: str
    root: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_folders: tuple[str, ...] = ()
    hidden: bool = False
    kinds: tuple[str, ...] = field(default=())
    ignore_names: tuple[str, ...] = (".gitignore", ".ignore")


def any_of(path: Column, globs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(path_glob_to_regex(g if "/" in g else f"**/{g}"))
    return out


def gate(source: Source, path: Column) -> Column:
    """Whether a source takes the path (relative to its root)."""
    ok = kinds.kind(path).isNotNull()
    for folder in (*JUNK_FOLDERS, *source.exclude_folders):
        ok = ok & ~F.concat(F.lit("/"), path).contains(f"/{folder}/")
    ok = ok & ~F.regexp_extract(path, r"([^/]+)$", 1).isin(*JUNK_NAMES)
    if not source.hidden:
        ok = ok & ~F.concat(F.lit("/"), path).rlike(r"/\.[^/]")
    if source.include:
        ok = ok & any_of(path, source.include)
    if source.exclude:
        ok = ok & ~any_of(path, source.exclude)
    if source.kinds:
        ok = ok & kinds.kind(path).isin(*source.kinds)
    return ok


def ignored(spark: SparkSession, root: str, files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``files`` (rel) without those that ignore files of their folders name. Listings leave hidden files out, so the driver
    looks for rules in each folder that holds files, and in those above it; their text decides for every path below. Paths alone go to Python."""
    held = {r["folder"] for r in folders(files, None).collect()}
    every = {"", *("/".join(f.split("/")[:i]) for f in held for i in range(1, f.count("/") + 2))}
    jvm, rules = spark.sparkContext._jvm, IgnoreRules()
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in sorted(every, key=lambda f: (f.count("/") + bool(f), f)):
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path("/".join(x for x in (root, folder, name) if x))
            if fs.exists(at):
                stream = fs.open(at)
                try:
                    rules.add(folder, jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
    if not rules.rules:
        return files

    @F.pandas_udf("boolean")
    def kept(rel: pd.Series) -> pd.Series:
        return ~rel.map(rules.ignores).astype(bool)

    return files.filter(kept("rel"))


def walk(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(collection, source_ord, root, path, rel, kind, size, modified, content) of all files; content is read only if selected."""
    found = None
    for k, s in enumerate(sources):
        root = s.root.rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        clean = F.regexp_replace("path", "^[a-z0-9+.-]+:/*", "/")
        rel = F.substring(clean, F.lit(len(root.split("://")[-1].rstrip("/")) + 2), F.length(clean))
        rows = files.select(F.lit(s.collection).alias("collection"), F.lit(k).alias("source_ord"), F.lit(root).alias("root"), clean.alias("path"), rel.alias("rel"), kinds.kind(clean).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").cast("long").alias("modified"), "content")
        rows = rows.filter(gate(s, F.col("rel")))
        rows = ignored(spark, root, rows, s.ignore_names) if s.ignore_names else rows
        found = rows if found is None else found.unionByName(rows)
    return found


def claimed(files: DataFrame, by: str = "path") -> DataFrame:
    """A file that several sources of a collection reach belongs to the first."""
    first = F.row_number().over(Window.partitionBy("collection", by).orderBy("source_ord"))
    return files.withColumn("_k", first).filter("_k = 1").drop("_k")


def folders(files: DataFrame, most: int | None = 500) -> DataFrame:
    """Folders that hold files; ``most`` None gives all."""
    found = files.select(F.regexp_replace("rel", r"/?[^/]+$", "").alias("folder")).filter("folder != ''").distinct().orderBy("folder")
    return found if most is None else found.limit(most)


def sampled_counts(files: DataFrame, most: int = 2_000) -> DataFrame:
    """Kinds among the first files by path: (kind, n)."""
    return files.select("path", "kind").orderBy("path").limit(most).groupBy("kind").agg(F.count("*").alias("n"))
