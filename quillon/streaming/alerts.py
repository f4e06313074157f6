"""Windowed counts of a stream of sightings; ``stateful`` has what remembers more than a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sightings(events: DataFrame, key: str, when: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(key, start, frequency) of a stream: how often a parameter was seen in each window of event time.

    Events later than ``late`` behind the newest are dropped, which lets Spark forget windows that have closed.
    """
    return events.withWatermark(when, late).groupBy(F.window(when, window).alias("w"), key).agg(F.count("*").alias("frequency")).select(key, F.col("w.start").alias("start"), "frequency")
