"""Incremental forms of the additive operators (an extension beyond the batch surface)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_contingency(rows: DataFrame, pred: str, gt: str, time: str, window: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Contingency counts by event-time window over a stream (or a batch); late rows beyond the watermark are dropped."""
    return rows.withWatermark(time, watermark).groupBy(F.window(time, window), F.col(pred).alias("pred"), F.col(gt).alias("gt")).agg(F.count(F.lit(1)).alias("nij"))


def streaming_sizes(rows: DataFrame, label: str, time: str, window: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Instance sizes by event-time window."""
    return rows.withWatermark(time, watermark).groupBy(F.window(time, window), label).agg(F.count(F.lit(1)).alias("size"))
