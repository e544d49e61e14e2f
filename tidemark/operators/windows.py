"""Tumbling, hopping and session aggregation, plus cascades.

``keys`` may be few and badly skewed (one symbol with a third of all rows), so
no step sorts or collects the raw rows of one key: raw rows always meet a
partial hash aggregation first, and what is shuffled is one row per key and
window (or pane, or session cell) and map task.
"""

from math import gcd

from pyspark.sql import Window, functions as F

from ..functions import measures as M
from ..functions.time import align, hop, interval_ms, session, start_ms, tumble
from ..schemas import EVENT_TIME


def _finish(df, keys, measures, start, keep_window):
    cols = [*keys]
    if keep_window:
        cols.append("window")
    if start:
        cols.append(start_ms().alias(start))
    return df.select(*cols, *M.results(measures))


def tumble_agg(df, keys, size, measures, start="bar_start", event_time=EVENT_TIME,
               keep_window=False):
    """One row per key and tumbling window; the same plan serves batch and streams."""
    grouped = df.groupBy(*keys, tumble(size, event_time).alias("window"))
    return _finish(grouped.agg(*M.partials(measures)), keys, measures, start, keep_window)


def hop_agg(df, keys, size, slide, measures, start="bar_start", event_time=EVENT_TIME,
            panes=True, keep_window=False):
    """One row per key and hopping window.

    A raw row belongs to size/slide windows. With ``panes`` rows are first
    aggregated to panes of gcd(size, slide), and only panes are copied into
    their windows. A stream with ``panes`` needs append mode, since it chains two
    stateful aggregations; give ``panes=False`` for update mode.
    """
    if not panes:
        grouped = df.groupBy(*keys, hop(size, slide, event_time).alias("window"))
        return _finish(grouped.agg(*M.partials(measures)), keys, measures, start, keep_window)
    pane_ms = gcd(interval_ms(size), interval_ms(slide))
    pane = df.groupBy(*keys, tumble(pane_ms, event_time).alias("pane")).agg(*M.partials(measures))
    spread = hop(size, slide, F.window_time("pane")).alias("window")
    return _finish(
        pane.groupBy(*keys, spread).agg(*M.merges(measures)), keys, measures, start, keep_window
    )


def cascade_agg(bars, keys, size, measures, start="bar_start", keep_window=False):
    """Wider bars from the finer bars of ``tumble_agg(..., keep_window=True)``.

    The wider window is taken over the time of the finer window, so a stream
    can chain both levels (append mode).
    """
    wide = tumble(size, F.window_time("window")).alias("window")
    grouped = bars.groupBy(*keys, wide)
    return _finish(grouped.agg(*M.partials(measures)), keys, measures, start, keep_window)


def session_agg(df, keys, gap, measures, start="session_start", end="session_end",
                event_time=EVENT_TIME):
    """One row per key and session: a session ends where two rows are more than ``gap`` apart.

    ``start`` and ``end`` are the first and last event time of the session in
    milliseconds (pass None to leave one out).
    """
    if df.isStreaming:
        return _session_stream(df, keys, gap, measures, start, end, event_time)
    return _session_cells(df, keys, gap, measures, start, end, event_time)


def _bounds(start, end, s, e):
    out = []
    if start:
        out.append(s.alias(start))
    if end:
        out.append(e.alias(end))
    return out


def _session_stream(df, keys, gap, measures, start, end, event_time):
    grouped = df.groupBy(*keys, session(gap, event_time).alias("window"))
    last = F.unix_millis(F.col("window.end")) - F.lit(interval_ms(gap)).cast("long")
    return grouped.agg(*M.partials(measures)).select(
        *keys, *_bounds(start, end, start_ms(), last), *M.results(measures)
    )


def session_native(df, keys, gap, measures, start="session_start", end="session_end",
                   event_time=EVENT_TIME):
    """The plain ``session_window`` form, which sorts all rows of a key in one task."""
    return _session_stream(df, keys, gap, measures, start, end, event_time)


# Cells per merge group: bounds the rows one task sorts for one key.
CELLS_PER_BLOCK = 1 << 20


def _session_cells(df, keys, gap, measures, start, end, event_time,
                   cells_per_block=CELLS_PER_BLOCK):
    """Sessions without sorting raw rows.

    Rows of one key inside a cell of width ``gap`` are always one session, so
    raw rows hash-aggregate to cells. Cells then merge inside blocks of cells,
    and only the first and last piece of a block can continue into another one.
    """
    gap_us = interval_ms(gap) * 1000
    us = F.unix_micros(F.col(event_time))
    cells = (
        df.where(F.col(event_time).isNotNull())
        .groupBy(*keys, align(us, gap_us).alias("_cell"))
        .agg(F.min(us).alias("_s"), F.max(us).alias("_e"), *M.partials(measures))
        .withColumn("_block", align("_cell", gap_us * cells_per_block))
    )
    pieces = _merge_runs(cells, [*keys, "_block"], gap_us, measures)
    # Inner pieces are finished sessions; only those at the edges of blocks move once more.
    merged = _merge_runs(pieces.where("_edge").drop("_edge", "_run", "_block"), keys, gap_us, measures)
    ms = lambda c: F.floor(F.col(c) / 1000).cast("long")
    out = lambda df: df.select(*keys, *_bounds(start, end, ms("_s"), ms("_e")), *M.results(measures))
    return out(pieces.where("NOT _edge")).unionByName(out(merged))


def _merge_runs(df, part, gap_us, measures):
    """Merge neighbouring pieces of one group that are at most the gap apart.

    ``_edge`` tells whether a merged piece holds the first or last piece of its group.
    """
    w = Window.partitionBy(*part).orderBy("_s")
    prev_end = F.lag("_e").over(w)
    opens = F.when(prev_end.isNull() | (F.col("_s") - prev_end > gap_us), 1).otherwise(0)
    edge = prev_end.isNull() | F.lead("_s").over(w).isNull()
    return (
        df.withColumns({"_opens": opens, "_edge": edge})
        .withColumn("_run", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*part, "_run")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.max("_edge").alias("_edge"),
             *M.merges(measures))
    )
