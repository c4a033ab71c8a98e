"""The reductions over windows of a stream: the same aggregates, with a watermark for late rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomarray.operators.reductions import _mean, _moment, _sum

F64 = np.dtype("float64")


def statistics(value: Column) -> dict[str, Column]:
    """sum, mean, var, std, min, max and count of a double column; NaN propagates as in arrays."""
    bad = F.coalesce(F.bool_or(F.isnan(value)), F.lit(False))
    return {
        "count": F.count(value),
        "sum": _sum(F64, value),
        "mean": _mean(F64, value),
        "var": _moment(F64, value, 0, False),
        "std": _moment(F64, value, 0, True),
        "min": F.when(bad, math.nan).otherwise(F.min(value)),
        "max": F.max(value),
    }


def windowed(stream: DataFrame, time: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Statistics of each window (tumbling, or sliding with `slide`) and key; rows later than `late` are left out.

    Works on streams and on tables alike; state is one row a window and key.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late) if stream.isStreaming else stream
    grouped = out.groupBy(window, *(by or [])).agg(*(c.alias(n) for n, c in statistics(F.col(value).cast("double")).items()))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), *statistics(F.lit(0.0)))


def sessions(stream: DataFrame, time: str, value: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Statistics of sessions: rows of a key no further apart than `gap`."""
    out = stream.withWatermark(time, late) if stream.isStreaming else stream
    grouped = out.groupBy(F.session_window(time, gap), *by).agg(*(c.alias(n) for n, c in statistics(F.col(value).cast("double")).items()))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *statistics(F.lit(0.0)))
