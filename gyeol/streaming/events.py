"""Streaming over arriving rows: windows with late data, de-duplication, versions kept as state.

Every function takes a streaming DataFrame and returns one. ``drain`` runs a stream over what has arrived and gives the
result as a table in the shared checkpoint folder; a cluster job would start the same stream without an end.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.session import checkpoint_root


def read_events(spark: SparkSession, path: str, time: str = "ts", files_per_batch: int = 64) -> DataFrame:
    """A stream of a Parquet table's files with ``time`` as an instant."""
    schema = spark.read.parquet(path).schema
    watched = re.sub(r"(.)$", r"[\1]", path.rstrip("/"))  # as a pattern, a table may be one file or a folder of files
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(watched)
    return raw.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), by, "n", "total")
    )


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Runs of events of one user no further apart than ``gap``."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return g.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_arrivals(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once while its state is kept."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest_state(events: DataFrame, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """An update for each key whenever a newer version arrives: (key, order, versions). State is one row a key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        best, n = state.get if state.exists else (-1, 0)
        before = best
        for f in frames:
            n += len(f)
            best = max(best, int(f[order].max()))
        state.update((best, n))
        if best > before:
            yield pd.DataFrame({key: [k[0]], order: [best], "versions": [n]})

    rows = events.select(key, order)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, versions long", "best long, n long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append", timeout_s: int = 300) -> DataFrame:
    """Run a stream over all that has arrived, exactly once into a table, and read that table."""
    spark = stream.sparkSession
    at = f"{checkpoint_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    if not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError("the stream didn't end")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
