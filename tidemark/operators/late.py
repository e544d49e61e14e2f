"""Late rows of a batch, by the rule a watermark applies to a stream."""

from pyspark.sql import Window, functions as F

from ..functions.time import interval_ms
from .ordered import carry


def mark_late(df, arrival, segments, delay, ts="ts", keys=(), since=None):
    """Add ``watermark`` (ms) and ``is_late`` by arrival order.

    The watermark of a row is the largest event time that arrived before it,
    minus ``delay``. ``arrival`` orders the rows; ``segments`` are integer
    columns, coarse to fine, that cut the arrival order into consecutive runs.
    The running maximum scans only inside a run and continues from the maximum
    carried over earlier runs. ``since`` is the largest event time of rows that
    arrived before all of these.
    """
    part = [*keys, *segments]
    w = Window.partitionBy(*part).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*part).agg(F.max(ts).alias("_sum"))
    before = carry(cells, list(keys), list(segments), "max").select(*part, "_carry")
    seen = (
        df.withColumn("_local", F.max(ts).over(w))
        .join(before, part, "left")
        .withColumn("watermark", F.greatest("_local", "_carry", F.lit(since).cast("long")) - F.lit(interval_ms(delay)))
    )
    return seen.withColumn(
        "is_late", F.coalesce(F.col(ts) < F.col("watermark"), F.lit(False))
    ).drop("_local", "_carry")


def split_late(df, arrival, segments, delay, ts="ts", keys=()):
    """(on-time rows, late rows); together they are all rows."""
    marked = mark_late(df, arrival, segments, delay, ts, keys)
    return marked.where("NOT is_late").drop("is_late"), marked.where("is_late").drop("is_late")
