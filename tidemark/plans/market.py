"""Bars, volumes, bursts, matches and neighbours over trades, quotes and orders.

Each function takes DataFrames (batch, or streams with a watermark) and returns
the result shape of ``schemas.OUTPUTS`` plus the window start or row id.
"""

from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.time import interval_ms
from ..operators import analytic, joins, windows

SYMBOL = ["symbol"]


def ohlc(trades, size, order):
    return windows.tumble_agg(trades, SYMBOL, size, M.ohlc("price", order))


def ohlc_full(trades, size, order, keep_window=False):
    return windows.tumble_agg(
        trades, SYMBOL, size, M.ohlc("price", order, "volume"), keep_window=keep_window
    )


def ohlc_cascade(trades, fine, coarse, order):
    """Coarse bars computed from fine bars."""
    bars = ohlc_full(trades, fine, order, keep_window=True)
    return windows.cascade_agg(bars, SYMBOL, coarse, M.roll_up_ohlc("bar_start"))


def ohlc_volatility(trades, size, order):
    return windows.tumble_agg(
        trades, SYMBOL, size,
        [*M.ohlc("price", order, "volume"), M.value_range("price", "price_range")],
    )


def hop_volume(trades, size, slide, panes=True):
    return windows.hop_agg(trades, SYMBOL, size, slide, [
        M.total("volume", "total_volume"), M.count_rows("trade_count"),
        M.mean("price", "avg_price"),
    ], panes=panes)


def burst_measures():
    return [
        M.count_rows("burst_trades"), M.total("volume", "burst_volume"),
        M.lowest("price", "low"), M.highest("price", "high"),
    ]


def hop_percentiles(trades, size, slide, percent):
    """Count, extremes and percentiles of the price per symbol and hopping window, as one struct."""
    return windows.hop_agg(trades, ["symbol"], size, slide, [M.quantiles("price", "prices", percent)])


def session_burst(trades, gap, keys=("symbol",)):
    return windows.session_agg(trades, list(keys), gap, burst_measures())


def trade_summary(trades, size):
    return windows.tumble_agg(
        trades, SYMBOL, size, [M.count_rows("trades"), M.notional(name="notional")]
    )


def window_counts(trades, size):
    return windows.tumble_agg(trades, SYMBOL, size, [M.count_rows("cnt")])


def volume_counts(trades, size, above=None):
    """Trade count and volume per window; ``above`` keeps windows with more volume (HAVING)."""
    out = windows.tumble_agg(
        trades, SYMBOL, size,
        [M.count_rows("trade_count"), M.total("volume", "total_volume")],
    )
    return out if above is None else out.where(F.col("total_volume") > above)


def asof_enriched(trades, quotes, tolerance, extra=()):
    """Each trade with the newest quote of its symbol, at most ``tolerance`` old."""
    hit = joins.asof_join(
        trades, quotes, SYMBOL, ["bid", "ask"], tiebreak="quote_id", tolerance=tolerance
    )
    return hit.select(
        *extra, "symbol", F.col("price").alias("trade_price"), "volume", "bid", "ask",
        (F.col("price") - F.col("bid")).alias("spread"),
    )


def trade_order_match(trades, orders, lower, upper, where=None, extra=()):
    """Trades and orders of one symbol whose times lie in a band."""
    return joins.band_join(trades, orders, SYMBOL, lower, upper, [
        *extra, "l.symbol", "l.price AS trade_price", "l.volume", "r.order_id", "r.side",
        "r.price AS order_price", "l.price - r.price AS price_diff",
    ], where=where)


def forward_match(trades, orders, within, extra=()):
    """Trades from the order's time up to ``within`` later, at or above the order's price."""
    return trade_order_match(
        trades, orders, -interval_ms(within), 0, "l.price >= r.price", extra
    )


def lag_price(trades, tiebreak=None, **options):
    return analytic.lag(
        trades, SYMBOL, "price", "prev_price", tiebreak=tiebreak, default=-1.0, **options
    )


def lead_price(trades, tiebreak=None, **options):
    return analytic.lead(
        trades, SYMBOL, "price", "next_price", tiebreak=tiebreak, default=-1.0, **options
    )
