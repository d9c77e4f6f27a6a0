"""Structured Streaming over the event log: windows as an extension, and the decision fold kept as state.

Late data: the order of a log is its seq, never arrival; windows drop what is older than the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col


def stamped(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with time zone; the tables have one without."""
    return events.withColumn("ts", c("ts").cast("timestamp"))


def tumbling(events: DataFrame, minutes: int = 60, late_minutes: int = 10) -> DataFrame:
    """Count and sum by type in windows; the same plan for a batch and a stream."""
    rows = stamped(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", f"{late_minutes} minutes")
    g = rows.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(c("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap_minutes: int = 30, late_minutes: int = 10) -> DataFrame:
    """Sessions of each user: events with gaps below gap_minutes."""
    rows = stamped(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", f"{late_minutes} minutes")
    g = rows.groupBy(F.session_window("ts", f"{gap_minutes} minutes"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", c("session_window.start").alias("start"), "n", "total")


def latest_values(decisions: DataFrame, key: str = "user_id", seq: str = "event_id", value: str = "value") -> DataFrame:
    """Running latest value of each key by seq, as state: (key, last_seq, last_value, n) after each batch."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, latest, n = state.get if state.exists else (-1, 0.0, 0)
        for rows in batches:
            n += len(rows)
            top = rows.loc[rows[seq].idxmax()]
            if int(top[seq]) > last:
                last, latest = int(top[seq]), float(top[value])
        state.update((last, latest, n))
        yield pd.DataFrame({key: [k[0]], "last_seq": [last], "last_value": [latest], "n": [n]})

    return decisions.groupBy(key).applyInPandasWithState(
        fold, f"{key} long, last_seq long, last_value double, n long", "last_seq long, last_value double, n long", "update", GroupStateTimeout.NoTimeout
    )


def stream_of(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema that they have."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(directory)
