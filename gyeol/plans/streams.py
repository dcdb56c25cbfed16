"""Streaming queries run to the end of the events that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.plans.base import query
from gyeol.streaming import events

_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _read(spark: SparkSession, d: str) -> DataFrame:
    return events.read_events(spark, f"{d}/events.parquet")


@query(
    "stream_tumbling",
    f"""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_MARK} GROUP BY 1, 2""",
)
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by type; windows that the watermark has passed."""
    return events.drain(events.tumbling(_read(spark, d))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_sliding",
    f"""SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) WHERE s + INTERVAL 2 DAY <= {_MARK} GROUP BY 1""",
)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return events.drain(events.sliding(_read(spark, d))).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "stream_sessions",
    f"""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 12 HOUR <= {_MARK}
""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = events.drain(events.sessions(_read(spark, d)))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("stream_first_arrivals", "SELECT event_id, user_id FROM events")
def stream_first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return events.drain(events.first_arrivals(_read(spark, d))).select("event_id", "user_id")


@query("stream_latest_version", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_latest_version(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user, kept as state and reduced over its updates."""
    return events.drain(events.latest_state(_read(spark, d))).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
