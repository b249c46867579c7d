"""Outlines: the tree of headings of each file, and headings that pages share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outline(chunks: DataFrame) -> DataFrame:
    """(parent_id, depth, title, chunk_seq): a row for each heading where it first stands, in order. A chunk's heading path names its
    ancestors; those that its predecessor has too are not new."""
    side = Window.partitionBy("parent_id").orderBy("chunk_seq")
    parts = F.filter(F.split(F.coalesce("heading_path", F.lit("")), " > "), lambda p: p != "")
    rows = chunks.select("parent_id", "chunk_seq", parts.alias("path")).withColumn("before", F.coalesce(F.lag("path").over(side), F.array().cast("array<string>")))
    rows = rows.select("parent_id", "chunk_seq", "path", "before", F.posexplode("path").alias("depth", "title"))
    known = F.slice("path", F.lit(1), F.col("depth") + 1) == F.slice("before", F.lit(1), F.col("depth") + 1)
    return rows.filter(~known).select("parent_id", (F.col("depth") + 1).alias("depth"), "title", "chunk_seq")


def headings_of_pages(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """(parent_id, page, heading_path): each page under the last entry of a table of contents at or before it. An as-of join: both
    sides go through one window, so nothing is compared pair by pair."""
    marked = contents.select("parent_id", "page", F.col("title").alias("heading"), F.lit(0).alias("side")).unionByName(pages.select("parent_id", "page", F.lit(None).cast("string").alias("heading"), F.lit(1).alias("side")))
    order = Window.partitionBy("parent_id").orderBy("page", "side").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("heading_path", F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit(""))).filter("side = 1").select("parent_id", "page", "heading_path")


def owns_heading(chunks: DataFrame) -> DataFrame:
    """Whether a chunk is the first under its heading."""
    side = Window.partitionBy("parent_id").orderBy("chunk_seq")
    before = F.lag("heading_path").over(side)
    return chunks.withColumn("owns_heading", before.isNull() | (before != F.col("heading_path")))
