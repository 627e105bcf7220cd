"""Counts in cells over a stream of points: pixel counts are a plain streaming aggregate, so any batch curve works on its state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import Roi, pixel


def pixel_counts(points: DataFrame, roi: Roi, keys: list[str], time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(keys[, window], gx, gy, c) of a streaming or batch table of points, in event-time windows if ``time`` is given."""
    cols = {f"g{a}": pixel(F.col(a), o, s, roi.grid) for a, o, s in zip(roi.axes, roi.origin, roi.size, strict=True)}
    rows = points.withColumns(cols)
    if time is None:
        return rows.groupBy(*keys, *cols).agg(F.count("*").alias("c"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(*keys, F.window(time, window).alias("window"), *cols).agg(F.count("*").alias("c"))
