"""Queries of streams over ``events``; each runs a stream to its end and equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.scratch import scratch
from corvane.streaming import arrivals
from corvane.suite.common import query, table


def _stream(spark, sf_dir):
    """The table's file as a stream's input: a folder of one link would do; here the rows are written once."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark, "events")
    rows.write.parquet(path)
    return arrivals.event_stream(spark, path, rows.schema)


def _ended(spark, stream, name: str, mode: str = "complete"):
    return arrivals.run_to_end(stream, scratch(spark, f"stream-{name}"), scratch(spark, f"checkpoint-{name}"), mode)


@query("windowed_arrivals", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_arrivals(spark, sf_dir):
    rows = arrivals.windowed(table(spark, sf_dir, "events"))
    return rows.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "session_arrivals",
    """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM y GROUP BY user_id, k""",
)
def session_arrivals(spark, sf_dir):
    return arrivals.sessions(table(spark, sf_dir, "events"))


@query("stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    counts = _stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return _ended(spark, counts, "stream_counts")


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    rows = arrivals.windowed(_stream(spark, sf_dir), "1 day", "1000 days").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    return _ended(spark, rows, "stream_windows")


@query("dedupe_replay", "SELECT event_id, user_id, event_type FROM events")
def dedupe_replay(spark, sf_dir):
    """Every event comes twice; the stream lets one through."""
    twice = _stream(spark, sf_dir)
    rows = arrivals.without_replays(twice.unionByName(_stream(spark, sf_dir)), "1000 days").select("event_id", "user_id", "event_type")
    return _ended(spark, rows, "dedupe_replay", "append")
