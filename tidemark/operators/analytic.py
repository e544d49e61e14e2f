"""LAG and LEAD."""

from pyspark.sql import Window, functions as F

from ..functions.time import interval_ms
from ..session import pin
from .ordered import HOT_ROWS, carry, rank_in_segment, segments


def lag_window(df, keys, order, col, name, offset=1, default=None):
    """LAG as one window per key: right for keys of moderate size."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.lag(col, offset, default).over(w))


def lead_window(df, keys, order, col, name, offset=1, default=None):
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.lead(col, offset, default).over(w))


def lag(df, keys, col, name, time="ts", tiebreak=None, offset=1, default=None,
        segment="1 hour", hot_rows=HOT_ROWS):
    """Value of the row ``offset`` rows earlier in (time, tiebreak) order, else ``default``.

    Without a tiebreak the value itself orders the rows of one instant. Nulls come
    first.
    The rows of a key are spread over time segments; the first row of a segment
    takes the last row of the nearest earlier segment.
    """
    return _neighbour(df, keys, col, name, time, tiebreak, offset, default, segment, hot_rows, -1)


def lead(df, keys, col, name, time="ts", tiebreak=None, offset=1, default=None,
         segment="1 hour", hot_rows=HOT_ROWS):
    """Value of the row ``offset`` rows later, else ``default``; see ``lag``."""
    return _neighbour(df, keys, col, name, time, tiebreak, offset, default, segment, hot_rows, 1)


def _neighbour(df, keys, col, name, time, tiebreak, offset, default, segment, hot_rows, step):
    tiebreak = tiebreak or col
    order = [time, tiebreak]
    width = interval_ms(segment)
    cut, levels, between = segments(df, keys, time, width, tiebreak, hot_rows)
    rank = rank_in_segment(time, tiebreak, width, between)
    none = F.struct(F.lit(default).cast(df.schema[col].dataType).alias("v"))
    source = F.col(col)
    # A wider offset is the same one-row shift taken repeatedly.
    for _ in range(offset):
        near = _shift(cut, keys, levels, order, rank, source, step)
        cut = near.withColumn("_shift", F.coalesce(F.col("_near"), none)["v"]).drop("_near")
        source = F.col("_shift")
    return cut.withColumn(name, F.col("_shift")).drop("_shift", *levels)


def _shift(cut, keys, levels, order, rank, source, step):
    """Add ``_near``: the neighbour's value in a struct, which is null only at the edge of a key."""
    part = [*keys, *levels]
    w = Window.partitionBy(*part).orderBy(*order)
    value = F.struct(source.alias("v"))
    local = cut.withColumn("_near", (F.lag(value) if step < 0 else F.lead(value)).over(w))
    edge = F.max_by(source, rank) if step < 0 else F.min_by(source, rank)
    cells = cut.groupBy(*part).agg(edge.alias("v")).select(*part, F.struct("v").alias("_sum"))
    if len(levels) > 1:
        cells = pin(cells)  # every level reads them again
    # Carrying backwards is carrying forwards over negated segments.
    turn = (lambda d: d.withColumns({c: -F.col(c) for c in levels})) if step > 0 else (lambda d: d)
    moved = turn(carry(turn(cells), keys, levels, "last")).select(*part, "_carry")
    return (
        local.join(moved, part, "left")
        .withColumn("_near", F.coalesce("_near", "_carry"))
        .drop("_carry")
    )
