"""Streams over the events table, run to the end of what is there and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import graph as G
from ..streaming import ingest
from .registry import query


def _events(spark, d):
    """The table as a stream, whether it is one file or a folder of files; event time needs a zoned timestamp."""
    schema = G.table(spark, d, "events").schema
    return ingest.read_stream(spark, f"{d}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL", with_graph=False)
def stream_dedup(spark, d):
    s = ingest.dedup(_events(spark, d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days")
    return ingest.run(s, None, "append", "dedup").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL", with_graph=False)
def stream_tumbling(spark, d):
    return _plain(ingest.run(ingest.windowed(_events(spark, d), "ts", "6 hours", None, ["event_type"], None), ["start", "event_type"], "update", "tumbling"), "start")


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY ALL", with_graph=False)
def stream_sliding(spark, d):
    return _plain(ingest.run(ingest.windowed(_events(spark, d), "ts", "12 hours", "6 hours", ["event_type"], None), ["start", "event_type"], "update", "sliding"), "start")


@query("SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - prev < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, g", with_graph=False)
def stream_sessions(spark, d):
    return _plain(ingest.run(ingest.sessions(_events(spark, d), "ts", "6 hours", ["user_id"], "60 days"), ["start", "user_id"], "complete", "sessions"), "start")


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen FROM events GROUP BY user_id", with_graph=False)
def stream_registry(spark, d):
    return _plain(ingest.run(ingest.first_and_last(_events(spark, d), "user_id", "ts"), ["user_id"], "update", "registry"), "first_seen", "last_seen")
