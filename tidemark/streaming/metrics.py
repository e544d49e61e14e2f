"""Counts and watermarks of sources, as tables; ``progress`` has those of running queries."""

from pyspark.sql import functions as F

from ..functions.time import interval_ms


def source_metrics(df, name, delay, ts="ts", keys=()):
    """One row per source (and key): rows, time range and final watermark."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        (F.max(ts) - F.lit(interval_ms(delay))).alias("watermark"),
    ).select(F.lit(name).alias("source"), *keys, "rows", "first_ts", "last_ts", "watermark")
