"""Keeping an index in step with its sources: differences of snapshots, memberships, and files to read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stale(indexed: DataFrame, live: DataFrame, unreadable: list[str] | None = None) -> DataFrame:
    """Indexed files that are gone, without those under folders that could not be read."""
    gone = indexed.join(live.select("parent_id"), "parent_id", "left_anti")
    for folder in unreadable or []:
        gone = gone.filter(~F.startswith(F.col("path"), F.lit(folder.rstrip("/") + "/")))
    return gone


def must_read(seen_mtime: Column, mtime: Column, seen_ctime: Column, ctime: Column) -> Column:
    """A file is read again if it is new, its time moved, or its known change time did."""
    moved = (seen_ctime > 0) & (ctime > 0) & (seen_ctime != ctime)
    return seen_mtime.isNull() | (seen_mtime != mtime) | F.coalesce(moved, F.lit(False))


def to_read(live: DataFrame, seen: DataFrame) -> DataFrame:
    """Live files that changed since ``seen``; both have (parent_id, mtime, ctime)."""
    before = seen.select("parent_id", F.col("mtime").alias("seen_mtime"), F.col("ctime").alias("seen_ctime"))
    rows = live.join(before, "parent_id", "left")
    return rows.filter(must_read(F.col("seen_mtime"), F.col("mtime"), F.col("seen_ctime"), F.col("ctime"))).drop("seen_mtime", "seen_ctime")


def upserted(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks with all of a file's replaced by its fresh ones; a file without fresh chunks keeps what it had."""
    return chunks.join(fresh.select("parent_id").distinct(), "parent_id", "left_anti").unionByName(fresh)


def after_index(memberships: DataFrame, collection: str, pairs: DataFrame) -> DataFrame:
    """Memberships (parent_id, collection, source) with a collection's replaced for the files of ``pairs`` (parent_id, source)."""
    others = memberships.join(pairs.select("parent_id", F.lit(collection).alias("collection")).distinct(), ["parent_id", "collection"], "left_anti")
    return others.unionByName(pairs.select("parent_id", F.lit(collection).alias("collection"), "source"))


def after_prune(memberships: DataFrame, collection: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships without those of pruned files in a collection, and the files that belong to nothing now."""
    kept = memberships.join(gone.select("parent_id", F.lit(collection).alias("collection")), ["parent_id", "collection"], "left_anti")
    return kept, gone.select("parent_id").join(kept.select("parent_id").distinct(), "parent_id", "left_anti")


def extraction_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Contents that no extraction is cached for, under whatever signature."""
    return files.dropDuplicates(["content_hash"]).join(cache.select("content_hash").distinct(), "content_hash", "left_anti")


def orphans(cache: DataFrame, files: DataFrame) -> DataFrame:
    return cache.join(files.select("content_hash").distinct(), "content_hash", "left_anti")


def freshness(built: dict | None, now: dict) -> str:
    """CURRENT, NEEDS_UPDATE, NEEDS_REBUILD or NOT_INDEXED, from what an index was built with and what holds now."""
    if not built:
        return "NOT_INDEXED"
    if built.get("version") != now.get("version") or built.get("chunking") != now.get("chunking"):
        return "NEEDS_REBUILD"
    return "CURRENT" if built.get("sources") == now.get("sources") and built.get("seen_at", 0) >= now.get("changed_at", 0) else "NEEDS_UPDATE"
