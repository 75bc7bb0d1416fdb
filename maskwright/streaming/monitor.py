"""A running k-anonymity monitor over an event stream. An extension: the study it serves is batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``start, <keys>, n``: sizes of the classes of each window; late rows count until the watermark passes.

    The state is one counter for each class of an open window.
    """
    # watermarks need a timestamp with a time zone
    windowed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    got = windowed.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("start"), *keys, "n")


def small_classes(counts: DataFrame, k: int) -> DataFrame:
    return counts.filter(F.col("n") < k)
