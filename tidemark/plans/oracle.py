"""The same queries as SQL text, for checking results with another engine."""

HOUR = 3_600_000
BAND = 600_000
DELAY, QUOTE_DELAY, ORDER_DELAY = 10_000, 1_200_000, 2_400_000

TRADES = """
t AS (
  SELECT event_id, 'ACCT-' || CAST(user_id AS VARCHAR) AS account_id, event_type AS symbol,
         CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, value AS price,
         CAST(json_extract(props, '$.k') AS BIGINT) AS volume,
         epoch_us(ts) // 1000 AS ts, epoch_us(ts) AS seq
  FROM events)"""
QUOTES = """
q AS (
  SELECT event_id AS quote_id, symbol, price * (1 - 0.0005::DOUBLE) AS bid,
         price * (1 + 0.0005::DOUBLE) AS ask, ts - volume * 10000 AS ts
  FROM t)"""
ORDERS = """
o AS (
  SELECT event_id AS order_no, 'ORD-' || CAST(event_id AS VARCHAR) AS order_id, account_id,
         symbol, side, volume AS quantity, price, ts - volume * 20000 AS ts
  FROM t)"""
CHANGES = """
c AS (
  SELECT CAST(o_orderkey AS INTEGER) AS id, CAST(o_custkey AS INTEGER) AS customer_id,
         o_totalprice AS amount, o_orderpriority AS status, o_orderkey AS lsn,
         epoch_us(o_orderdate) // 1000 AS ts,
         CASE o_orderstatus WHEN 'O' THEN 'I' WHEN 'F' THEN 'U' ELSE 'D' END AS op
  FROM orders)"""


def _with(body, *ctes):
    return "WITH " + ",".join(ctes) + body


def t(body, *ctes):
    return _with(body, TRADES, *ctes)


def _bars(size, having=""):
    return f"""
SELECT symbol, (ts // {size}) * {size} AS bar_start, arg_min(price, seq) AS open,
       max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
       CAST(sum(volume) AS BIGINT) AS volume
FROM t GROUP BY 1, 2 {having}"""


_SHUFFLED = """
, m AS (SELECT *, (event_id * 37) % 1009 AS place, max(ts) OVER (
          ORDER BY (event_id * 37) % 1009, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 259200000 AS watermark FROM t)"""


def _closed(size, end="bar_start + {size}"):
    # A window is out once the watermark (newest event time less the delay) passes its end.
    return end.format(size=size) + f" <= (SELECT max(ts) - {DELAY} FROM t)"


def _sessions(key, gap):
    return f"""
, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) <= {gap}
                       THEN 0 ELSE 1 END AS opens FROM t),
n AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY ts, event_id
                                 ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT {key}, min(ts) AS session_start, max(ts) AS session_end, count(*) AS burst_trades,
       CAST(sum(volume) AS BIGINT) AS burst_volume, min(price) AS low, max(price) AS high
FROM n GROUP BY {key}, sid"""


def _hop(size, slide):
    n = size // slide
    return f"""
SELECT symbol, (ts // {slide} - i) * {slide} AS bar_start,
       CAST(sum(volume) AS BIGINT) AS total_volume, count(*) AS trade_count,
       round(1e-7 + avg(price), 4) AS avg_price
FROM t, range(0, {n}) r(i) GROUP BY 1, 2"""


# Whether percentiles are within their bound is decided by exact ranks; here it must hold everywhere.
_PERCENTILES = f"""
SELECT symbol, (ts // {HOUR} - i) * {HOUR} AS bar_start, count(price) AS n, min(price) AS low, max(price) AS high,
       true AS p50_in_bound, true AS p99_in_bound
FROM t, range(0, 6) r(i) GROUP BY 1, 2"""


def _match(cols, cond):
    return f"""
SELECT t.event_id, t.symbol, t.price AS trade_price, t.volume, {cols},
       o.price AS order_price, round(1e-7 + t.price - o.price, 4) AS price_diff
FROM t JOIN o ON t.symbol = o.symbol AND {cond}"""


_SYMMETRIC = f"o.ts BETWEEN t.ts - {BAND} AND t.ts + {BAND}"
# Orders and quotes of one symbol may share an instant: the largest id counts.
_BEST_O = """
b AS (SELECT symbol, ts, max(order_no) AS order_no FROM o GROUP BY 1, 2),
ob AS (SELECT o.* FROM o JOIN b USING (symbol, ts, order_no))"""
_BEST_Q = """
b AS (SELECT symbol, ts, max(quote_id) AS quote_id FROM q GROUP BY 1, 2),
qb AS (SELECT q.* FROM q JOIN b USING (symbol, ts, quote_id))"""


def _asof_order(kind):
    return t(f"""
SELECT t.event_id, t.symbol, t.price AS trade_price, t.volume, t.account_id AS trade_account,
       o.order_id, o.account_id AS order_account, o.price AS order_price,
       round(1e-7 + t.price - o.price, 4) AS price_spread
FROM t ASOF {kind} JOIN ob o ON t.symbol = o.symbol AND t.ts >= o.ts""", ORDERS, _BEST_O)


def _neighbour(fn, name):
    return t(f"""
SELECT event_id, symbol, price,
       {fn}(price, 1, -1.0) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS {name}
FROM t""")


def _totals(where="op IN ('I', 'U')"):
    return f"""
SELECT customer_id, count(*) AS total_orders, round(1e-7 + sum(amount), 4) AS total_spent
FROM c WHERE {where} GROUP BY 1"""


def _wrap(inner, where):
    head, body = inner.rsplit("\nSELECT ", 1)
    return f"{head}\nSELECT * FROM (SELECT {body}) WHERE {where}"


def _summary(live=False):
    """Rows and totals per stream; ``live`` keeps what a drained stream has emitted."""
    def part(name, a, b, rows, done):
        where = f" WHERE {done}" if live else ""
        return f"""
SELECT '{name}' AS stream, count(*) AS rows, CAST(sum({a}) AS BIGINT) AS volume_total,
       round(sum(CAST({b} AS DOUBLE)), 2) AS value_total FROM ({rows}){where}"""

    ctes, tail = _sessions("account_id", 1_800_000).split("\nSELECT ", 1)
    hour = _closed(HOUR)
    parts = [
        part("vol_baseline", "total_volume", "avg_price",
             _hop(6 * HOUR, HOUR).replace("round(1e-7 + avg(price), 4)", "avg(price)"),
             _closed(6 * HOUR)),
        part("ohlc_vol", "volume", "high - low", _bars(HOUR), hour),
        part("rapid_fire", "burst_volume", "high", "SELECT " + tail,
             _closed(0, "session_end + 1800000")),
        part("wash_score", "buy_volume", "sell_volume", _WASH, hour),
        part("suspicious_match", "volume", "order_price",
             _match("o.order_id, o.account_id, o.side", _SYMMETRIC), "true"),
        part("asof_match", "volume", "order_price", """
SELECT t.ts, t.volume, o.price AS order_price
FROM t ASOF JOIN ob o ON t.symbol = o.symbol AND t.ts >= o.ts""",
             f"ts <= {_SLOWER.format(r='o', wait=ORDER_DELAY)}"),
    ]
    return t(ctes + "\n" + "\nUNION ALL".join(parts), ORDERS, _BEST_O)


_WASH = f"""
SELECT account_id, symbol, (ts // {HOUR}) * {HOUR} AS bar_start,
       CAST(sum(CASE WHEN side = 'buy' THEN volume ELSE 0 END) AS BIGINT) AS buy_volume,
       CAST(sum(CASE WHEN side = 'sell' THEN volume ELSE 0 END) AS BIGINT) AS sell_volume,
       CAST(sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) AS BIGINT) AS buy_count,
       CAST(sum(CASE WHEN side = 'sell' THEN 1 ELSE 0 END) AS BIGINT) AS sell_count
FROM t GROUP BY 1, 2, 3"""
_SUMMARY = f"""
SELECT symbol, (ts // {HOUR}) * {HOUR} AS bar_start, count(*) AS trades,
       round(1e-7 + sum(price * CAST(volume AS DOUBLE)), 4) AS notional
FROM t GROUP BY 1, 2"""
_COUNTS = f"""
SELECT symbol, (ts // {HOUR}) * {HOUR} AS bar_start, count(*) AS trade_count,
       CAST(sum(volume) AS BIGINT) AS total_volume
FROM t GROUP BY 1, 2"""
_CNT = f"SELECT symbol, (ts // {HOUR}) * {HOUR} AS bar_start, count(*) AS cnt FROM t GROUP BY 1, 2"
# Both inputs of a stream join advance with the slower one.
_SLOWER = f"(SELECT least((SELECT max(ts) FROM t) - {DELAY}, (SELECT max(ts) FROM {{r}}) - {{wait}}))"

_CURRENT = """
SELECT customer_id, id, amount, op FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY lsn DESC) AS rn FROM c)
WHERE rn = 1 AND op <> 'D'"""

ORACLE = {
    "passthrough": t("\nSELECT event_id, symbol, price, volume, ts FROM t"),
    "projection_casts": t(f"""
SELECT event_id, symbol AS name, round(1e-7 + price * CAST(volume AS DOUBLE), 4) AS notional,
       CASE WHEN side = 'buy' THEN volume ELSE CAST(0 AS BIGINT) END AS buy_volume,
       CAST(trunc(price) AS BIGINT) AS whole_price, (ts // {HOUR}) * {HOUR} AS bar_start
FROM t WHERE price >= 1.0 AND volume BETWEEN 10 AND 90"""),
    "side_filter": t("\nSELECT event_id, symbol, side FROM t WHERE symbol IN ('click', 'purchase')"),
    "tumble_ohlc": t(_bars(HOUR)),
    "sql_tumble": t(f"""
SELECT (ts // {HOUR}) * {HOUR} AS hour_start, count(*) AS trades,
       count(*) FILTER (WHERE side = 'buy') AS buys, max(volume) AS largest
FROM t GROUP BY 1 HAVING count(*) > 1"""),
    "hop_volume": t(_hop(6 * HOUR, HOUR)),
    "session_burst": t(_sessions("symbol", 1_800_000)),
    "rapid_fire": t(_sessions("account_id", 1_800_000)),
    "ohlc_volatility": t(f"\nSELECT *, round(1e-7 + high - low, 4) AS price_range FROM ({_bars(HOUR)})"),
    "wash_score": t(_WASH),
    "trade_summary": t(_SUMMARY),
    "window_count": t("\n" + _CNT),
    "having_volume": t(_COUNTS + " HAVING sum(volume) > 200"),
    "having_impossible": t(_COUNTS + " HAVING sum(volume) > 99999999"),
    "cascade_ohlc": t(_bars(6 * HOUR)),
    "running_totals": t("""
SELECT account_id, count(*) AS trades, round(1e-7 + sum(price), 4) AS spent FROM t GROUP BY 1"""),
    "interval_match": t(_match("o.order_id, o.side", _SYMMETRIC), ORDERS),
    "suspicious_match": t(_match("o.order_id, o.account_id, o.side", _SYMMETRIC), ORDERS),
    "forward_match": t(
        _match("o.order_id, o.side", f"t.ts BETWEEN o.ts AND o.ts + {BAND}")
        + " WHERE t.price >= o.price", ORDERS),
    "asof_quote": t(f"""
SELECT t.event_id, t.symbol, t.price AS trade_price, t.volume, round(1e-7 + q.bid, 4) AS bid,
       round(1e-7 + q.ask, 4) AS ask, round(1e-7 + t.price - q.bid, 4) AS spread
FROM t ASOF JOIN qb q ON t.symbol = q.symbol AND t.ts >= q.ts
WHERE t.ts - q.ts <= {BAND}""", QUOTES, _BEST_Q),
    "asof_order": _asof_order(""),
    "asof_order_left": _asof_order("LEFT"),
    "lookup_nation": """
SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "lag_price": _neighbour("lag", "prev_price"),
    "lead_price": _neighbour("lead", "next_price"),
    "percentiles": t("""
, s AS (SELECT symbol, list(price ORDER BY price) AS v, count(*) AS n FROM t GROUP BY 1)
SELECT symbol, v[n * 50 // 100 + 1] AS p50, v[least(n * 99 // 100, n - 1) + 1] AS p99 FROM s"""),
    "hop_percentiles": t(_PERCENTILES),
    "recent_n": t(f"""
SELECT symbol, bar_start, open, high, low, close, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_start DESC) AS rn
  FROM ({_bars(HOUR)})) WHERE rn <= 50"""),
    "latest_price": t("""
SELECT symbol, arg_max(price, seq) AS price, arg_max(ts, seq) AS ts FROM t GROUP BY 1"""),
    "throughput": t("""
SELECT symbol, tick, rows FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY tick DESC) AS rn FROM (
    SELECT symbol, (ts // 1000) * 1000 AS tick, count(*) AS rows FROM t GROUP BY 1, 2))
WHERE rn <= 60"""),
    "source_metrics": t(f"""
SELECT 'trades' AS source, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts,
       max(ts) - {DELAY} AS watermark FROM t
UNION ALL SELECT 'quotes', count(*), min(ts), max(ts), max(ts) - {QUOTE_DELAY} FROM q
UNION ALL SELECT 'orders', count(*), min(ts), max(ts), max(ts) - {ORDER_DELAY} FROM o""",
                        QUOTES, ORDERS),
    "late_split": t("""
, m AS (SELECT event_id, ts, max(ts) OVER (
          ORDER BY (event_id * 37) % 1009, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 259200000 AS watermark FROM t)
SELECT event_id, ts, watermark, coalesce(ts < watermark, false) AS is_late FROM m"""),
    "customer_totals": _with(_totals(), CHANGES),
    "cdc_log_totals": _with(_totals("op IN ('I', 'U') AND customer_id <> 0"), CHANGES),
    "cdc_log_rows": _with("""
SELECT id, customer_id, amount, status, ts FROM c
WHERE op IN ('I', 'U') AND customer_id <> 0""", CHANGES),
    "customer_current": _with(_CURRENT, CHANGES),
    "stream_current": _with(_CURRENT, CHANGES),
    "changelog_totals": _with(f"""
, a AS ({_totals()}),
b AS ({_totals("op IN ('I', 'U') AND ts < epoch_ms(TIMESTAMP '1997-01-01')")}),
j AS (SELECT coalesce(a.customer_id, b.customer_id) AS customer_id,
             a.customer_id IS NOT NULL AS ha, b.customer_id IS NOT NULL AS hb,
             a.total_orders AS ao, a.total_spent AS asp, b.total_orders AS bo, b.total_spent AS bsp
      FROM a FULL JOIN b ON a.customer_id = b.customer_id),
m AS (SELECT * FROM j WHERE NOT (ha AND hb AND ao = bo AND asp = bsp))
SELECT customer_id, CASE WHEN ha THEN '-U' ELSE '-D' END AS change, bo AS total_orders,
       bsp AS total_spent FROM m WHERE hb
UNION ALL
SELECT customer_id, CASE WHEN hb THEN '+U' ELSE '+I' END, ao, asp FROM m WHERE ha""", CHANGES),
    "json_encode": t("""
SELECT symbol AS key, CAST(to_json({'event_id': event_id, 'symbol': symbol, 'price': price,
       'volume': volume, 'ts': ts}) AS VARCHAR) AS value FROM t"""),
    "json_decode": t("\nSELECT symbol, price, volume, ts FROM t"),
    "json_field": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "stream_tumble": t(_wrap(_bars(HOUR), _closed(HOUR))),
    "stream_hop": t(_wrap(_hop(6 * HOUR, HOUR), _closed(6 * HOUR))),
    "stream_percentiles": t(_wrap(_PERCENTILES, _closed(6 * HOUR))),
    "stream_session": t(_wrap(
        _sessions("symbol", 1_800_000), _closed(0, "session_end + 1800000"))),
    "stream_having": t(_wrap(_COUNTS + " HAVING sum(volume) > 200", _closed(HOUR))),
    "stream_cascade": t(_wrap(_bars(6 * HOUR), _closed(6 * HOUR))),
    "stream_match": t(_match("o.order_id, o.account_id, o.side", _SYMMETRIC), ORDERS),
    "stream_update": t(_bars(HOUR)),
    "stream_totals": _with(_totals(), CHANGES),
    # A row for each customer and micro-batch: the new totals, and before them the old ones.
    "stream_changes": _with(f"""
, r AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) - min(o_orderkey) + 1 AS span FROM orders),
b AS (SELECT c.customer_id, (c.lsn - r.lo) * 8 // r.span AS batch, count(*) AS n, sum(c.amount) AS s
      FROM c, r WHERE c.op IN ('I', 'U') GROUP BY 1, 2),
v AS (SELECT customer_id, batch, CAST(sum(n) OVER w AS BIGINT) AS total_orders, sum(s) OVER w AS total_spent
      FROM b WINDOW w AS (PARTITION BY customer_id ORDER BY batch)),
x AS (SELECT *, lead(batch) OVER w AS later, lag(batch) OVER w AS earlier FROM v
      WINDOW w AS (PARTITION BY customer_id ORDER BY batch))
SELECT customer_id, CASE WHEN earlier IS NULL THEN '+I' ELSE '+U' END AS change, total_orders,
       round(1e-7 + total_spent, 4) AS total_spent FROM x
UNION ALL
SELECT customer_id, '-U', total_orders, round(1e-7 + total_spent, 4) FROM x WHERE later IS NOT NULL""", CHANGES),
    "stream_current_totals": _with("""
, n AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY lsn DESC) AS k FROM c)
SELECT status, count(*) AS customers, round(1e-7 + sum(amount), 4) AS amount, round(1e-7 + min(amount), 4) AS least,
       round(1e-7 + max(amount), 4) AS greatest FROM n WHERE k = 1 AND op <> 'D' GROUP BY 1""", CHANGES),
    "cdc_cutover_totals": _with("""
, r AS (SELECT (min(lsn) + max(lsn)) // 2 AS cut FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY lsn DESC) AS k FROM c, r WHERE lsn <= cut),
a AS (SELECT customer_id, amount FROM n WHERE k = 1 AND op <> 'D'
      UNION ALL SELECT customer_id, amount FROM c, r WHERE lsn > cut AND op IN ('I', 'U'))
SELECT customer_id, count(*) AS total_orders, round(1e-7 + sum(amount), 4) AS total_spent FROM a GROUP BY 1""", CHANGES),
    "stream_session_updates": t(_sessions("symbol", 1_800_000)),
    "stream_recent": t("""
SELECT * FROM (SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank,
                      event_id, price, volume, ts FROM t) WHERE rank <= 50"""),
    "stream_latest": t("""
SELECT symbol, arg_max(price, seq) AS price, arg_max(ts, seq) AS ts FROM t GROUP BY 1"""),
    "stream_throughput": t(f"""
SELECT * FROM (SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY tick DESC) AS INTEGER) AS rank, tick, rows FROM (
  SELECT symbol, (ts // {HOUR}) * {HOUR} AS tick, count(*) AS rows FROM t GROUP BY 1, 2)) WHERE rank <= 60"""),
    "stream_lag": t(f"""
SELECT event_id, symbol, price, prev_price FROM (
  SELECT *, lag(price, 1, -1.0) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS prev_price
  FROM t) WHERE ts <= (SELECT max(ts) - {DELAY} FROM t)"""),
    "stream_lead": t(f"""
SELECT event_id, symbol, price, next_price FROM (
  SELECT *, lead(price) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS next_price
  FROM t WHERE ts <= (SELECT max(ts) - {DELAY} FROM t)) WHERE next_price IS NOT NULL"""),
    "stream_asof": t(f"""
SELECT t.event_id, t.symbol, t.price, o.order_id, o.price AS order_price
FROM t ASOF JOIN ob o ON t.symbol = o.symbol AND t.ts >= o.ts
WHERE t.ts <= {_SLOWER.format(r='o', wait=ORDER_DELAY)}""", ORDERS, _BEST_O),
    "stream_asof_quote": t(f"""
SELECT t.event_id, t.symbol, t.price, q.quote_id, round(1e-7 + q.bid, 4) AS bid, round(1e-7 + q.ask, 4) AS ask
FROM t ASOF JOIN qb q ON t.symbol = q.symbol AND t.ts >= q.ts
WHERE t.ts - q.ts <= {BAND} AND t.ts + 1 <= {_SLOWER.format(r='q', wait=QUOTE_DELAY)} - {BAND}""", QUOTES, _BEST_Q),
    "stream_lookup": t("""
SELECT t.event_id, t.account_id, c.c_name
FROM t JOIN customer c ON t.account_id = 'ACCT-' || CAST(c.c_custkey AS VARCHAR)"""),
    # A micro-batch drops what belongs to windows that the watermark before the last one has closed.
    "stream_late": t(f"""
, a AS (SELECT *, (event_id * 37) % 1009 AS place FROM t),
r AS (SELECT min(place) AS lo, max(place) - min(place) + 1 AS span FROM a),
b AS (SELECT symbol, (ts // {HOUR}) * {HOUR} AS bar_start, a.ts, (place - r.lo) * 8 // r.span AS batch FROM a, r),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)
             - 259200000 AS mark FROM b GROUP BY 1)
SELECT symbol, bar_start, count(*) AS cnt FROM b JOIN m USING (batch)
WHERE mark IS NULL OR bar_start + {HOUR} > mark
GROUP BY 1, 2 HAVING bar_start + {HOUR} <= (SELECT max(ts) - 259200000 FROM t)"""),
    "stream_late_rows": t(_SHUFFLED + "\nSELECT event_id, symbol, ts, watermark FROM m WHERE ts < watermark"),
    "stream_late_counts": t(_SHUFFLED + """
, r AS (SELECT min(place) AS lo, max(place) - min(place) + 1 AS span FROM m),
b AS (SELECT (place - r.lo) * 8 // r.span AS batch_id, ts, coalesce(ts < watermark, false) AS late FROM m, r),
c AS (SELECT batch_id, count(*) AS rows_in, count(*) FILTER (late) AS rows_late,
             count(*) FILTER (NOT late) AS rows_on_time, max(ts) AS newest FROM b GROUP BY 1)
SELECT batch_id, rows_in, rows_late, rows_on_time, max(newest) OVER (ORDER BY batch_id) AS high_water FROM c"""),
    "stream_on_time": t(_SHUFFLED + f"""
, k AS (SELECT * FROM m WHERE NOT coalesce(ts < watermark, false))
SELECT symbol, (ts // {HOUR}) * {HOUR} AS bar_start, count(*) AS cnt FROM k
GROUP BY 1, 2 HAVING bar_start + {HOUR} <= (SELECT max(ts) - 259200000 FROM k)"""),
    # A micro-batch closes windows by the newest time of those before it; the last one has no rows.
    "stream_progress": t(_SHUFFLED + f"""
, r AS (SELECT min(place) AS lo, max(place) - min(place) + 1 AS span FROM m),
s AS (SELECT (place - r.lo) * 8 // r.span AS batch_id, coalesce(ts < watermark, false) AS late FROM m, r),
p AS (SELECT min(event_id) AS lo, max(event_id) - min(event_id) + 1 AS span FROM t),
e AS (SELECT ts, (event_id - p.lo) * 8 // p.span AS batch_id FROM t, p),
i AS (SELECT batch_id, count(*) AS rows_in, max(ts) AS newest FROM e GROUP BY 1),
k AS (SELECT x AS batch_id, max(newest) - {DELAY} AS mark FROM range(0, 9) n(x) LEFT JOIN i ON i.batch_id < x GROUP BY 1),
w AS (SELECT DISTINCT symbol, (ts // {HOUR}) * {HOUR} AS bar_start FROM t),
f AS (SELECT symbol, bar_start, min(batch_id) AS batch_id FROM w JOIN k ON bar_start + {HOUR} <= mark GROUP BY 1, 2),
g AS (SELECT batch_id, count(*) AS rows_out FROM f GROUP BY 1)
SELECT 'late_split' AS query, batch_id, count(*) AS rows_in, count(*) FILTER (late) AS rows_late,
       count(*) FILTER (NOT late) AS rows_out FROM s GROUP BY 2
UNION ALL
SELECT 'bars', k.batch_id, coalesce(rows_in, 0), 0, coalesce(rows_out, 0)
FROM k LEFT JOIN i USING (batch_id) LEFT JOIN g USING (batch_id) WHERE coalesce(rows_in, 0) + coalesce(rows_out, 0) > 0"""),
    "fanout": t(f"""
, r AS (SELECT * FROM ({_SUMMARY}) WHERE {_closed(HOUR)})
SELECT *, 'table' AS target FROM r UNION ALL SELECT *, 'topic' AS target FROM r"""),
    "foreach_batch": t("\nSELECT symbol, count(*) AS rows FROM t GROUP BY 1"),
    "append_ingest": t("""
SELECT symbol, count(*) AS rows, CAST(sum(volume) AS BIGINT) AS volume FROM t GROUP BY 1"""),
    "table_sink_rows": t(_bars(HOUR)),
    "fraud_detection": _summary(),
    "stream_detection": _summary(live=True),
}
