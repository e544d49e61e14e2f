"""Aggregates that can be taken in stages.

A measure names its partial aggregates over raw rows, how partials combine, and
the expression that turns them into the result. One stage is an ordinary
``groupBy().agg()``; several stages serve hop panes, session cells and
cascades. All partials of the numeric measures are fixed-width, so Spark plans
hash aggregation with map-side combine.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Part:
    """A partial aggregate; ``row`` is its value for a single row, ``fold`` says how values combine.

    ``fold`` is "sum", "min" or "max", or ("min_by" | "max_by", suffix of the part it goes by).
    Both are None for sketches, which only combine by ``again``.
    """

    suffix: str
    first: Column
    again: Callable[[Callable[[str], Column]], Column]
    row: Column | None
    fold: str | tuple | None


@dataclass(frozen=True)
class Measure:
    name: str
    parts: tuple
    finish: Callable[[Callable[[str], Column]], Column]

    def get(self, suffix):
        return F.col(f"{self.name}__{suffix}")


def partials(measures):
    return [p.first.alias(f"{m.name}__{p.suffix}") for m in measures for p in m.parts]


def merges(measures):
    return [p.again(m.get).alias(f"{m.name}__{p.suffix}") for m in measures for p in m.parts]


def row_partials(measures):
    """The partials of single rows, for states that fold them in Python."""
    for m in measures:
        if any(p.row is None for p in m.parts):
            raise ValueError(f"{m.name} is a sketch and can't be folded row by row")
    return [p.row.alias(f"{m.name}__{p.suffix}") for m in measures for p in m.parts]


def folds(measures):
    """How each partial folds: its column, ("sum" | "min" | "max" | "min_by" | "max_by", the column it goes by)."""
    out = {}
    for m in measures:
        for p in m.parts:
            kind, by = (p.fold, p.suffix) if isinstance(p.fold, str) else p.fold
            out[f"{m.name}__{p.suffix}"] = (kind, f"{m.name}__{by}")
    return out


def results(measures):
    return [m.finish(m.get).alias(m.name) for m in measures]


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _order(order):
    """One order column stays a plain fixed-width value; several become a struct.

    A struct makes Spark sort instead of hash, so give a tiebreak only where
    order values repeat.
    """
    cols = [order] if isinstance(order, (str, Column)) else list(order)
    return _col(cols[0]) if len(cols) == 1 else F.struct(*[_col(c) for c in cols])


def _simple(name, expr, again, row, fold):
    return Measure(name, (Part("v", expr, lambda g: again(g("v")), row, fold),), lambda g: g("v"))


def count_rows(name):
    return _simple(name, F.count(F.lit(1)), F.sum, F.lit(1).cast("long"), "sum")


def total(col, name):
    return _simple(name, F.sum(_col(col)), F.sum, _col(col), "sum")


def lowest(col, name):
    return _simple(name, F.min(_col(col)), F.min, _col(col), "min")


def highest(col, name):
    return _simple(name, F.max(_col(col)), F.max, _col(col), "max")


def mean(col, name):
    c = _col(col)
    return Measure(
        name,
        (
            Part("s", F.sum(c.cast("double")), lambda g: F.sum(g("s")), c.cast("double"), "sum"),
            Part("n", F.count(c), lambda g: F.sum(g("n")), c.isNotNull().cast("long"), "sum"),
        ),
        lambda g: g("s") / g("n"),
    )


def value_range(col, name):
    """Expression over aggregates: max - min."""
    c = _col(col)
    return Measure(
        name,
        (
            Part("hi", F.max(c), lambda g: F.max(g("hi")), c, "max"),
            Part("lo", F.min(c), lambda g: F.min(g("lo")), c, "min"),
        ),
        lambda g: g("hi") - g("lo"),
    )


def opening(col, name, order):
    """Value of the earliest row (``first_value`` with a defined order)."""
    o = _order(order)
    return Measure(
        name,
        (
            Part("v", F.min_by(_col(col), o), lambda g: F.min_by(g("v"), g("o")), _col(col), ("min_by", "o")),
            Part("o", F.min(o), lambda g: F.min(g("o")), o, "min"),
        ),
        lambda g: g("v"),
    )


def closing(col, name, order):
    """Value of the latest row (``last_value`` with a defined order)."""
    o = _order(order)
    return Measure(
        name,
        (
            Part("v", F.max_by(_col(col), o), lambda g: F.max_by(g("v"), g("o")), _col(col), ("max_by", "o")),
            Part("o", F.max(o), lambda g: F.max(g("o")), o, "max"),
        ),
        lambda g: g("v"),
    )


# The rank error of a sketch of this width is below 0.4 % of the rows with 99 % confidence.
SKETCH_WIDTH = 800


def quantiles(col, name, percent, width=SKETCH_WIDTH):
    """Percentiles from one mergeable sketch: a struct of ``n``, ``low``, ``high`` and a field for each percentage.

    ``percent`` maps field to percentage. The sketch has a few kilobytes however many rows
    it has seen, so panes, session cells and stream state hold sketches and not values.
    Count, lowest and highest value are exact, and so is all of a group of fewer than
    ``width`` rows. Nulls and NaN are left out; the struct is null where nothing is left.
    """
    c = _col(col).cast("double")
    value = F.when(~F.isnan(c), c)
    at = lambda s, p: F.kll_sketch_get_quantile_double(s, F.lit(p / 100.0))

    def finish(g):
        s = g("k")
        fields = [F.kll_sketch_get_n_double(s).alias("n"), at(s, 0).alias("low"), at(s, 100).alias("high")]
        fields += [at(s, p).alias(f) for f, p in percent.items()]
        return F.when(F.kll_sketch_get_n_double(s) > 0, F.struct(*fields))

    part = Part("k", F.kll_sketch_agg_double(value, width), lambda g: F.kll_merge_agg_double(g("k"), width), None, None)
    return Measure(name, (part,), finish)


def total_if(condition, col, name):
    return total(F.when(condition, _col(col)).otherwise(F.lit(0).cast("long")), name)


def count_if(condition, name):
    return total(F.when(condition, 1).otherwise(0).cast("long"), name)


def notional(price="price", volume="volume", name="notional"):
    return total(_col(price) * _col(volume).cast("double"), name)


def ohlc(price, order, volume=None):
    """Open, high, low, close and, if asked, volume.

    ``order`` must tell all rows of a window apart, or open and close are not
    defined; one number (such as ``seq`` of the given trades) keeps hash aggregation.
    """
    bar = [
        opening(price, "open", order),
        highest(price, "high"),
        lowest(price, "low"),
        closing(price, "close", order),
    ]
    return bar + ([total(volume, "volume")] if volume else [])


def roll_up_ohlc(order):
    """Combine finished bars into wider bars; ``order`` is the start of the finer bar."""
    return [
        opening("open", "open", order),
        highest("high", "high"),
        lowest("low", "low"),
        closing("close", "close", order),
        total("volume", "volume"),
    ]
