"""An index brought up to date in slices, as a stream of events.

Each slice is a whole new generation that says which files it holds. So a run may stop between any two events, or
die within a slice: the next run compares the live files with those of the newest generation and goes on with what is left.
"""

from __future__ import annotations

import datetime as dt
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.index import SearchIndex, latest, update_index, write_index
from corvane.operators.maintenance import stale, to_read

SLICE_FILES, RESUME_HOURS = 10_000, 24.0


@dataclass(frozen=True)
class Event:
    """``kind``: enumerated, indexed, pruned, stopped or done; files done and files in all; the generation that holds them."""

    kind: str
    done: int
    total: int
    generation: int


def bring_up_to_date(live: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], path: str, *, unreadable: list[str] | None = None, slice_files: int = SLICE_FILES, seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> Iterator[Event]:
    """Events of a run. ``live`` has (parent_id, path, mtime, ctime) of every file that should be in the index, ``chunks_of`` makes the
    chunks of some of them. Files that have not changed are not read; files that are gone are taken out, unless their folder
    could not be read. After ``seconds`` the run stops at the end of a slice."""
    spark, began = live.sparkSession, clock()
    columns = ["parent_id", "path", "mtime", "ctime"]
    index = SearchIndex.open(spark, path) if latest(spark, path) else None
    known = index.files if index is not None and index.files is not None else spark.createDataFrame([], live.select(*columns).schema)
    todo = to_read(live, known)
    total = todo.count()
    yield Event("enumerated", 0, total, index.generation if index else 0)
    slices = max(1, math.ceil(total / slice_files))
    done = 0
    for k in range(slices) if total else ():
        some = todo.filter(F.pmod(F.xxhash64("parent_id"), F.lit(slices)) == k)
        n = some.count()
        if not n:
            continue
        held = known.join(some.select("parent_id"), "parent_id", "left_anti").select(*columns).unionByName(some.select(*columns))
        # A file without chunks now has none; its own rows go all the same.
        fresh = chunks_of(some)
        index = write_index(fresh, path, files=held) if index is None else update_index(index, fresh, some.select("parent_id"), held)
        known, done = index.files, done + n
        yield Event("indexed", done, total, index.generation)
        if seconds is not None and clock() - began > seconds and k + 1 < slices:
            yield Event("stopped", done, total, index.generation)
            return
    if index is not None:
        gone = stale(known, live, unreadable)
        n = gone.count()
        if n:
            index = update_index(index, index.chunks.limit(0), gone.select("parent_id"), known.join(gone.select("parent_id"), "parent_id", "left_anti"))
            yield Event("pruned", n, n, index.generation)
    yield Event("done", done, total, index.generation if index else 0)


def update_files(files: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], path: str) -> int:
    """The changed ones of some files, brought into the index; files that are not named stay. Gives the generation."""
    spark = files.sparkSession
    columns = ["parent_id", "path", "mtime", "ctime"]
    index = SearchIndex.open(spark, path) if latest(spark, path) else None
    known = index.files if index is not None and index.files is not None else spark.createDataFrame([], files.select(*columns).schema)
    some = to_read(files, known)
    if some.isEmpty():
        return index.generation if index else 0
    held = known.join(some.select("parent_id"), "parent_id", "left_anti").select(*columns).unionByName(some.select(*columns))
    fresh = chunks_of(some)
    return (write_index(fresh, path, files=held) if index is None else update_index(index, fresh, some.select("parent_id"), held)).generation


def resumable(state: dict | None, known_collections: set[str], now: dt.datetime, most_hours: float = RESUME_HOURS) -> bool:
    """Whether a saved run should go on by itself: unfinished, of a collection that there is, and touched within the last hours."""
    if not state or not 0 <= state.get("files_completed", 0) < state.get("total_files", 0) or state.get("collection") not in known_collections:
        return False
    try:
        at = dt.datetime.fromisoformat(state.get("last_update") or state.get("started_at") or "")
    except ValueError:
        return False
    at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    return dt.timedelta(0) <= now - at <= dt.timedelta(hours=most_hours)
