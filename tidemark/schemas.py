"""Declared schemas. Event time is always the epoch-millisecond column ``ts``."""

from pyspark.sql import types as T


def _row(*fields):
    return T.StructType([T.StructField(n, t, False) for n, t in fields])


_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()

TIME = "ts"
EVENT_TIME = "event_time"

# --- fixed values: source schemas -------------------------------------------
TRADES = _row(("symbol", _S), ("price", _D), ("volume", _L), ("ts", _L))
QUOTES = _row(("symbol", _S), ("bid", _D), ("ask", _D), ("ts", _L))
ORDERS = _row(
    ("order_id", _S), ("symbol", _S), ("side", _S),
    ("quantity", _L), ("price", _D), ("ts", _L),
)
FRAUD_TRADES = _row(
    ("account_id", _S), ("symbol", _S), ("side", _S), ("price", _D),
    ("volume", _L), ("order_ref", _S), ("ts", _L),
)
FRAUD_ORDERS = _row(
    ("order_id", _S), ("account_id", _S), ("symbol", _S), ("side", _S),
    ("quantity", _L), ("price", _D), ("ts", _L),
)
CDC_ORDERS = _row(
    ("id", _I), ("customer_id", _I), ("amount", _D), ("status", _S), ("ts", _L)
)
CDC_ENVELOPE = T.StructType([
    T.StructField("_table", _S, False),
    T.StructField("_op", _S, False),
    T.StructField("_lsn", T.DecimalType(20, 0), False),
    T.StructField("_ts_ms", _L, False),
    T.StructField("_before", _S, True),
    T.StructField("_after", _S, True),
])
KAFKA_RECORD = T.StructType([
    T.StructField("key", T.BinaryType(), True),
    T.StructField("value", T.BinaryType(), True),
])
LOG_LINE = T.StructType([T.StructField("value", _S, True)])

SOURCES = {
    "trades": TRADES,
    "quotes": QUOTES,
    "orders": ORDERS,
    "fraud_trades": FRAUD_TRADES,
    "fraud_orders": FRAUD_ORDERS,
    "cdc_orders": CDC_ORDERS,
}

# --- fixed values: result columns, in order ---------------------------------
OUTPUTS = {
    "ohlc": ["symbol", "open", "high", "low", "close"],
    "ohlc_full": ["symbol", "bar_start", "open", "high", "low", "close", "volume"],
    "asof_enriched": ["symbol", "trade_price", "volume", "bid", "ask", "spread"],
    "trade_order_match": [
        "symbol", "trade_price", "volume", "order_id", "side", "order_price", "price_diff",
    ],
    "trade_summary": ["symbol", "trades", "notional"],
    "customer_total": ["customer_id", "total_orders", "total_spent"],
    "vol_baseline": ["symbol", "total_volume", "trade_count", "avg_price"],
    "ohlc_vol": [
        "symbol", "bar_start", "open", "high", "low", "close", "volume", "price_range",
    ],
    "rapid_fire": ["account_id", "burst_trades", "burst_volume", "low", "high"],
    "session_burst": ["symbol", "burst_trades", "burst_volume", "low", "high"],
    "wash_score": [
        "account_id", "symbol", "buy_volume", "sell_volume", "buy_count", "sell_count",
    ],
    "suspicious_match": [
        "symbol", "trade_price", "volume", "order_id", "account_id", "side",
        "order_price", "price_diff",
    ],
    "asof_match": [
        "symbol", "trade_price", "volume", "trade_account", "order_id",
        "order_account", "order_price", "price_spread",
    ],
    "interval_count": ["symbol", "trade_count", "total_volume"],
    "lag": ["symbol", "price", "prev_price"],
    "lead": ["symbol", "price", "next_price"],
}
