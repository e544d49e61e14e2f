"""Event-time columns, intervals and window columns."""

import re
from datetime import timedelta

from pyspark.sql import Column, functions as F

from ..schemas import EVENT_TIME, TIME

# fixed values: milliseconds per unit
UNIT_MS = {
    "millisecond": 1,
    "second": 1_000,
    "minute": 60_000,
    "hour": 3_600_000,
    "day": 86_400_000,
}
_TERM = re.compile(r"\s*(-?\d+)\s*([a-z]+?)s?\s*(?:,|$|(?=[\s\d-]))", re.IGNORECASE)


def interval_ms(span):
    """Milliseconds in ``span``: ``"5 seconds"``, ``"1 hour 30 minutes"``, a timedelta or an int."""
    if isinstance(span, timedelta):
        return span // timedelta(milliseconds=1)
    if isinstance(span, int):
        return span
    total, pos = 0, 0
    while pos < len(span):
        m = _TERM.match(span, pos)
        unit = m and UNIT_MS.get(m.group(2).lower())
        if not unit:
            raise ValueError(f"not an interval: {span!r}")
        total += int(m.group(1)) * unit
        pos = m.end()
    return total


def interval_lit(span):
    """``span`` as a day-time interval literal, for arithmetic on timestamps."""
    return F.lit(timedelta(milliseconds=interval_ms(span)))


def duration(span):
    """``span`` as the duration text that ``window`` and ``withWatermark`` take."""
    return f"{interval_ms(span)} milliseconds"


def with_event_time(df, ts=TIME, name=EVENT_TIME):
    """Add the timestamp column that windows and watermarks need."""
    return df.withColumn(name, F.timestamp_millis(F.col(ts)))


def align(col, width) -> Column:
    """Largest multiple of ``width`` that is not above the integer column ``col``."""
    c = F.col(col) if isinstance(col, str) else col
    return c - F.pmod(c, F.lit(width).cast("long"))


def window_start(ts, size) -> Column:
    """Start (ms) of the epoch-aligned tumbling window that holds epoch-ms column ``ts``."""
    return align(ts, interval_ms(size))


def tumble(size, event_time=EVENT_TIME) -> Column:
    return F.window(event_time, duration(size))


def hop(size, slide, event_time=EVENT_TIME) -> Column:
    """Hopping window; note the order size, slide."""
    return F.window(event_time, duration(size), duration(slide))


def session(gap, event_time=EVENT_TIME) -> Column:
    """Session window; events exactly ``gap`` apart still share a session."""
    return F.session_window(event_time, duration(gap))


def start_ms(window="window") -> Column:
    """Start of a window column in epoch milliseconds."""
    return F.unix_millis(F.col(f"{window}.start"))
