"""Facets: counts of files by tag and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.tags import ancestors

MOST_TAGS = 500


def tag_catalogue(files: DataFrame, tags: str = "tags", most: int | None = MOST_TAGS) -> DataFrame:
    """(tag, files): distinct files, not chunks, of each tag; the commonest first. ``most`` None gives all."""
    rows = files.select("parent_id", F.explode(F.array_distinct(F.col(tags))).alias("tag"))
    found = rows.groupBy("tag").agg(F.countDistinct("parent_id").alias("files")).orderBy(F.desc("files"), "tag")
    return found if most is None else found.limit(most)


def tag_tree(catalogue: DataFrame) -> DataFrame:
    """(tag, parent, depth, files): every tag and all its ancestors; one that no file has counts 0."""
    nodes = catalogue.select(F.explode(ancestors(F.col("tag"))).alias("tag")).distinct().join(catalogue, "tag", "left")
    depth = F.size(F.split("tag", "/"))
    return nodes.select("tag", F.when(depth > 1, F.regexp_replace("tag", "/[^/]*$", "")).alias("parent"), depth.alias("depth"), F.coalesce("files", F.lit(0)).alias("files"))


def present_kinds(chunks: DataFrame) -> DataFrame:
    return chunks.select("kind").distinct()


def files_of(chunks: DataFrame, collection: str) -> DataFrame:
    return chunks.filter(F.col("collection") == collection).select("parent_id").distinct()


def is_empty(chunks: DataFrame, collection: str) -> bool:
    return chunks.filter(F.col("collection") == collection).isEmpty()


def holding_removed(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """Collections that still hold files which are gone."""
    return chunks.select("collection", "parent_id").distinct().join(live, "parent_id", "left_anti").select("collection").distinct()


def files_matching(hits: DataFrame) -> DataFrame:
    """One row: how many files have a hit."""
    return hits.agg(F.countDistinct("parent_id").alias("files"))
