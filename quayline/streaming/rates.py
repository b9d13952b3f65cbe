"""Rate limits over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_exceeded_stream(
    rows: DataFrame, key: str, ts: str, limit: int, window: str = "5 minutes", slide: str = "1 minute", delay: str = "1 minute"
) -> DataFrame:
    """Keys with more than ``limit`` rows in a sliding window.

    An approximation of the exact trailing window: it looks at windows that end
    on multiples of ``slide``.  Rows later than ``delay`` are not counted.
    """
    counted = (
        rows.withWatermark(ts, delay)
        .groupBy(F.window(ts, window, slide), F.col(key))
        .agg(F.count("*").alias("requests"))
    )
    return counted.where(F.col("requests") > limit).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "requests"
    )


def end_marker(rows: DataFrame, ts: str, window: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """One row, NULL but for its time, that closes every window of a stream that has come
    to its end: written behind the rows, it moves the watermark past their last window.
    Its own windows stay open, so it is never counted.  Without rows its time is NULL."""
    last = rows.agg(F.max(ts).alias("last"))
    late = F.col("last") + F.expr(f"interval {window}") + F.expr(f"interval {delay}")
    return last.select(*[(late if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
