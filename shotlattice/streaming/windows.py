"""Event streams: windows with late data, and sessions. An addition; the batch operators do not depend on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def windowed(events: DataFrame, time: str, keys: list[str], length: str, slide: str | None, late: str, aggs: dict[str, Column]) -> DataFrame:
    """Tumbling, or with ``slide`` sliding, windows; rows later than ``late`` behind the newest are dropped when streamed."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str, aggs: dict[str, Column]) -> DataFrame:
    """Runs of rows at most ``gap`` apart."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)
