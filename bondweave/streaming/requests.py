"""Scoring requests as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import attach_reference


def recent_once(stream: DataFrame, keys: Sequence[str], time: str = "ts", within: str = "10 minutes") -> DataFrame:
    """Requests of which none with equal keys came within the time before; Spark forgets keys after it."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def score(stream: DataFrame, reference: DataFrame, keys: Sequence[str], default: float) -> DataFrame:
    """Each request with its reference from a static table, or the default; no state is kept."""
    return attach_reference(stream, reference, keys, default)


def counts_by_window(stream: DataFrame, time: str = "ts", length: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Requests by tumbling window; late ones count until the watermark has passed."""
    g = stream.withWatermark(time, length).groupBy(F.window(time, length), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), *by, "n")
