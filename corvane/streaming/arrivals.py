"""Streams of events: windows with watermarks, sessions, replays, and an index kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.streaming.indexer import update_files


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, end, event_type, n, total) per window; with a stream, windows close as the watermark passes."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    got = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_replays(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once: within the watermark for streams, over everything for tables."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now goes through the stream into a table under ``path``; nothing passes through the driver. A batch has its own
    folder, which a batch that comes again writes anew. ``append`` answers with all batches, the other modes, whose batches state the whole
    result or what changed of it, with the last."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(path)
    if mode != "append":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def keep_indexed(files: DataFrame, path: str, checkpoint: str, chunks_of: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Every micro-batch of changed files (parent_id, path, mtime, ctime ...) replaces these files' chunks, as a new generation. Batches
    that come again find nothing changed."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            update_files(batch, chunks_of, path)

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
