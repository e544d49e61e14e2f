"""Stream forms of LAG, LEAD and as-of whose state is in built-in operators."""

from pyspark.sql import functions as F

from ..functions.time import interval_ms, tumble
from ..schemas import EVENT_TIME
from ..sinks.foreach import for_each_batch, table_target
from ..operators.analytic import lag_window
from .bands import band_newest


def stream_asof_band(left, right, on, right_cols, row_id, tolerance, tiebreak=None,
                     left_cols=(), ts="ts"):
    """As-of join with tolerance over two watermarked streams (append mode).

    A band join by chunks gives the newest candidate in each chunk of right rows
    (``bands``), and the newest of those is kept when the left row's instant is closed.
    """
    ms = interval_ms(tolerance)
    keep = [c for c in right_cols if c not in on]
    own, rank = [*on, row_id, ts, *left_cols], [ts, *([tiebreak] if tiebreak else [])]
    found = band_newest(left, right, on, -ms, 0, max(ms, 1), own, [*rank, *keep], ts, EVENT_TIME, tiebreak)
    pairs = found.select(
        *dict.fromkeys(own), EVENT_TIME, F.struct(F.col(f"r.{ts}").alias("match_ts"), *[F.col(f"r.{c}") for c in keep]).alias("_m"),
        F.struct(*[F.col(f"r.{c}") for c in rank]).alias("_rank"),
    )
    best = pairs.groupBy(*on, row_id, ts, *left_cols, tumble(1).alias("window")).agg(
        F.max_by("_m", "_rank").alias("_m")
    )
    return best.select(
        *on, row_id, ts, *left_cols, *[F.col(f"_m.{c}").alias(c) for c in [*keep, "match_ts"]]
    )


def per_batch_lag(df, keys, order, col, name, default, path, checkpoint):
    """LAG inside each micro-batch only: every batch starts again with ``default``."""
    target = table_target(path, transform=lambda b: lag_window(b, keys, order, col, name, 1, default))
    return for_each_batch(df, target, checkpoint)
