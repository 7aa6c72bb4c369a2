"""Event streams: windows with late data, sessions and running state, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet event files as a stream, some files a trigger; the schema is read once from the folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per window; events later than ``late`` behind the newest are dropped from a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, n) per overlapping window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): a user's events less than ``gap`` apart."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for pdf in batches:
        v = pdf["value"].dropna()
        n, total = n + len(pdf), total + float(v.sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) after each trigger, from state kept per user."""
    return events.groupBy("user_id").applyInPandasWithState(_update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream holds once all present input is read, as an in-memory table: for small results and tests."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
