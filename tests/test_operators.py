"""Operators against brute force, with skewed keys, ties and tiny limits."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import measures as M
from tidemark.functions.time import with_event_time
from tidemark.operators import analytic, joins, late, ranking, windows
from tidemark.operators.changelog import current_state, diff
from tidemark.operators.ordered import segments
from tidemark.plans import market


def _rows(n=600, seed=1, span=40_000, keys="AAAABC"):
    """Half of all rows on key A, and a third of them at one instant."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        ts = 7_000 if r.random() < 0.33 else r.randrange(span)
        out.append((i, r.choice(keys), round(r.uniform(1, 99), 2), r.randrange(10, 500), ts))
    return out


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def df(spark, rows):
    return with_event_time(
        spark.createDataFrame(rows, "id long, symbol string, price double, volume long, ts long")
    ).cache()


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def _sessions(rows, gap):
    out = []
    for key, rs in _by_key(rows).items():
        run = [rs[0]]
        for r in rs[1:]:
            if r[4] - run[-1][4] > gap:
                out.append((key, run))
                run = []
            run.append(r)
        out.append((key, run))
    return {(k, run[0][4], run[-1][4], len(run), sum(r[3] for r in run),
             min(r[2] for r in run), max(r[2] for r in run)) for k, run in out}


@pytest.mark.parametrize("gap,cells", [(1, 4096), (40, 1), (100, 3), (300, 1), (300, 4096)])
def test_session_cells(df, rows, gap, cells):
    got = windows._session_cells(
        df, ["symbol"], gap, market.burst_measures(), "s", "e", "event_time", cells
    )
    assert {tuple(r) for r in got.collect()} == _sessions(rows, gap)


def test_session_forms_agree(df):
    a = windows.session_agg(df, ["symbol"], 100, market.burst_measures())
    b = windows.session_native(df, ["symbol"], 100, market.burst_measures())
    assert sorted(a.collect()) == sorted(b.collect())


def test_session_gap_is_inclusive(spark):
    df = with_event_time(spark.createDataFrame(
        [("a", 0), ("a", 3_000), ("a", 6_001)], "symbol string, ts long"))
    got = windows.session_agg(df, ["symbol"], "3 seconds", [M.count_rows("n")])
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0, 3_000, 2), (6_001, 6_001, 1)]


def test_fifteen_sessions(spark):
    """Three bursts ten seconds apart, five batches of five symbols each."""
    rows = [
        (s, 1.0, 10, burst * 10_000 + batch * 100)
        for burst in range(3) for batch in range(5)
        for s in ["AAPL", "GOOGL", "MSFT", "AMZN", "TSLA"]
    ]
    df = with_event_time(
        spark.createDataFrame(rows, "symbol string, price double, volume long, ts long"))
    got = market.session_burst(df, "3 seconds").collect()
    assert len(got) == 15
    assert all(r.burst_trades == 5 for r in got)


@pytest.mark.parametrize("size,slide", [(10_000, 2_000), (9_000, 6_000), (5_000, 5_000)])
def test_hop_panes_equal_direct(df, size, slide):
    ms = [M.total("volume", "v"), M.count_rows("n"), M.lowest("price", "lo"),
          M.highest("price", "hi"), M.opening("price", "o", ["ts", "id"]),
          M.closing("price", "c", ["ts", "id"]), M.value_range("price", "r")]
    a = windows.hop_agg(df, ["symbol"], size, slide, ms, panes=True)
    b = windows.hop_agg(df, ["symbol"], size, slide, ms, panes=False)
    assert sorted(a.collect()) == sorted(b.collect())


def test_ohlc_tie_break(df, rows):
    got = windows.tumble_agg(df, ["symbol"], "5 seconds", M.ohlc("price", ["ts", "id"], "volume"))
    want = {}
    for key, rs in _by_key(rows).items():
        for r in rs:
            want.setdefault((key, r[4] // 5000 * 5000), []).append(r)
    assert {tuple(r) for r in got.collect()} == {
        (*k, v[0][2], max(r[2] for r in v), min(r[2] for r in v), v[-1][2], sum(r[3] for r in v))
        for k, v in want.items()
    }


def test_cascade_keeps_volume(df):
    fine = market.ohlc_full(df, "1 second", "ts")
    wide = market.ohlc_cascade(df, "1 second", "10 seconds", "ts")
    assert fine.agg(F.sum("volume")).first() == wide.agg(F.sum("volume")).first()


def test_having_impossible_threshold(df):
    assert market.volume_counts(df, "5 seconds").count() > 0
    assert market.volume_counts(df, "5 seconds", 99_999_999).count() == 0


# --- neighbours ---------------------------------------------------------------

@pytest.mark.parametrize("hot,offset", [(None, 1), (10_000, 1), (50, 1), (7, 2)])
@pytest.mark.parametrize("step", [analytic.lag, analytic.lead])
def test_neighbours(df, rows, hot, offset, step):
    got = step(df, ["symbol"], "price", "near", tiebreak="id", offset=offset, default=-1.0,
               segment=3_000, hot_rows=hot)
    want = {}
    for rs in _by_key(rows).values():
        for i, r in enumerate(rs):
            j = i - offset if step is analytic.lag else i + offset
            want[r[0]] = rs[j][2] if 0 <= j < len(rs) else -1.0
    assert {r.id: r.near for r in got.select("id", "near").collect()} == want


def test_neighbour_defaults_once_per_key(df):
    out = market.lag_price(df, "id").where("prev_price = -1.0")
    assert out.groupBy("symbol").count().where("count <> 1").count() == 0
    assert out.count() == 3


def test_null_neighbour_value_is_not_the_default(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0)], "symbol string, ts long, price double")
    got = analytic.lag(df, ["symbol"], "price", "p", default=-1.0).orderBy("ts").collect()
    assert [r.p for r in got] == [-1.0, None]


TIES = [
    ("int", [None, None, 1, 2, 2, None, 5, 3, 1]), ("string", ["b", None, "a", "b", "", None, "z", "y", "b"]),
    ("double", [None, 0.5, -1.0, 0.5, None, 2.0, 9.0, 1.0, 0.0]),
]


@pytest.mark.parametrize("kind,ties", TIES)
@pytest.mark.parametrize("hot", [None, 1, 10_000])
def test_neighbours_with_any_tiebreak(spark, kind, ties, hot):
    times = [10, 20, 20, 20, 4_000, 4_000, 9_000, 9_000, 9_000]
    rows = [("a", t, x, float(k)) for k, (t, x) in enumerate(zip(times, ties))]
    df = spark.createDataFrame(rows, f"symbol string, ts long, tie {kind}, price double").repartition(3)
    order = ["ts", "tie"]
    for step, flat in ((analytic.lag, analytic.lag_window), (analytic.lead, analytic.lead_window)):
        got = step(df, ["symbol"], "ts", "near", tiebreak="tie", default=-1, segment=1_000, hot_rows=hot)
        want = flat(df, ["symbol"], order, "ts", "near", 1, -1)
        assert sorted((r.ts, repr(r.tie), r.near) for r in got.collect()) == sorted((r.ts, repr(r.tie), r.near) for r in want.collect())


@pytest.mark.parametrize("hot", [None, 1, 10_000])
def test_neighbours_without_a_tiebreak_lose_no_value(spark, hot):
    rows = [("a", t, float(p)) for t, p in [(10, 3), (10, 1), (10, 2), (5_000, 9), (5_000, 8), (9_999, 4)]]
    df = spark.createDataFrame(rows, "symbol string, ts long, price double").repartition(3)
    got = analytic.lag(df, ["symbol"], "price", "p", default=-1.0, segment=1_000, hot_rows=hot)
    assert sorted((r.price, r.p) for r in got.collect()) == [
        (1.0, -1.0), (2.0, 1.0), (3.0, 2.0), (4.0, 9.0), (8.0, 3.0), (9.0, 8.0)]


@pytest.mark.parametrize("kind,ties", TIES)
def test_asof_with_any_tiebreak(spark, kind, ties):
    right = spark.createDataFrame(
        [("a", 100 * (k // 5), x, k) for k, x in enumerate(ties)], f"symbol string, ts long, tie {kind}, w int").repartition(3)
    left = spark.createDataFrame([("a", 50, 1), ("a", 100, 2), ("a", 900_000_000, 3)], "symbol string, ts long, v int")

    def best(part):
        key = lambda k: (ties[k] is not None, ties[k] if ties[k] is not None else 0 if kind != "string" else "", k)
        return max(part, key=key)

    want = {1: best(range(5)), 2: best(range(5, 9)), 3: best(range(5, 9))}
    for form in (joins.asof_join, joins.asof_window):
        got = form(left, right, ["symbol"], ["w"], tiebreak="tie").collect()
        assert {r.v: r.w for r in got} == want


def test_latest_comes_from_one_row(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 7, 3.0, 9), ("a", 7, 4.0, 2)], "k string, ts long, p double, q int")
    assert [tuple(r) for r in ranking.latest_by_key(df, ["k"], ["p", "q"], ["ts"]).collect()] == [("a", 4.0, 2)]


def test_open_and_close_with_equal_times(spark):
    from tidemark.functions import measures as M

    rows = [("a", 1_000, k, float(p)) for k, p in [(3, 30), (1, 10), (2, 20)]]
    df = with_event_time(spark.createDataFrame(rows, "symbol string, ts long, id long, price double")).withColumn(
        "seq", F.expr("CAST(CAST(ts AS DECIMAL(18,0)) * 10000000000000000000BD + id AS DECIMAL(38,0))"))
    bars = windows.tumble_agg(df, ["symbol"], "5 seconds", M.ohlc("price", "seq"))
    assert [(r["open"], r["close"]) for r in bars.collect()] == [(10.0, 30.0)]
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_hot_segments_are_cut(df):
    cut, levels, between = segments(df, ["symbol"], "ts", 10_000, "id", hot_rows=20)
    assert levels == ["_seg0", "_seg1", "_seg2"] and between == (0, 599)
    assert cut.count() == df.count()
    biggest = cut.groupBy("symbol", *levels).count().agg(F.max("count")).first()[0]
    assert biggest <= 40


# --- joins ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def right_rows():
    return [(i, k, p, v, max(ts - 900, 0)) for i, k, p, v, ts in _rows(400, 2)]


@pytest.fixture(scope="module")
def right(spark, right_rows):
    return with_event_time(
        spark.createDataFrame(right_rows, "rid long, symbol string, bid double, q long, ts long")
    ).cache()


@pytest.mark.parametrize("lower,upper,bucket", [
    (-2_000, 2_000, None), (-500, 0, 150), (0, 700, 60_000), (100, 300, None), (0, 0, None),
])
def test_band_join(df, right, rows, right_rows, lower, upper, bucket):
    got = joins.band_join(df, right, ["symbol"], lower, upper, ["l.id", "r.rid"], bucket=bucket)
    want = sorted(
        (a[0], b[0]) for a in rows for b in right_rows
        if a[1] == b[1] and a[4] + lower <= b[4] <= a[4] + upper
    )
    assert sorted(tuple(r) for r in got.collect()) == want


def test_band_join_of_small_tables_is_spread(spark):
    """No table goes out whole, times meet as integers, and null keys and times match nothing."""
    left = with_event_time(spark.createDataFrame([(1, "a", 0), (2, "a", 500), (3, None, 0), (4, "a", None)], "id long, symbol string, ts long"))
    right = left.withColumnRenamed("id", "rid")
    got = joins.band_join(left, right, ["symbol"], -100, 0, ["l.id", "r.rid"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "INTERVAL" not in plan and "SortMergeJoin" in plan
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 2)]


def _asof(rows, right_rows, tolerance):
    by = _by_key(right_rows)
    out = {}
    for r in rows:
        rs = by.get(r[1], [])
        i = bisect.bisect_right([x[4] for x in rs], r[4]) - 1
        hit = rs[i] if i >= 0 and (tolerance is None or r[4] - rs[i][4] <= tolerance) else None
        out[r[0]] = (hit[0], hit[2], hit[4]) if hit else (None, None, None)
    return out


@pytest.mark.parametrize("form,tolerance,how", [
    ("instants", None, "inner"), ("instants", None, "left"), ("instants", 0, "inner"),
    ("instants", 50, "left"), ("instants", 1_000, "inner"),
    ("window", None, "inner"), ("window", 1_000, "left"),
])
def test_asof(df, right, rows, right_rows, tolerance, how, form):
    if form != "window":
        got = joins.asof_join(df, right, ["symbol"], ["rid", "bid"], tiebreak="rid",
                              tolerance=tolerance, how=how, bucket=2_000)
    else:
        got = joins.asof_window(df, right, ["symbol"], ["rid", "bid"], tiebreak="rid",
                                tolerance=tolerance, how=how)
    want = _asof(rows, right_rows, tolerance)
    if how == "inner":
        want = {k: v for k, v in want.items() if v[0] is not None}
    assert {r.id: (r.rid, r.bid, r.match_ts) for r in got.collect()} == want
    assert got.count() == len(want)


def test_asof_keeps_duplicate_left_rows(spark, right):
    left = spark.createDataFrame([("A", 9_000)] * 5, "symbol string, ts long")
    assert joins.asof_join(left, right, ["symbol"], ["rid"], tiebreak="rid").count() == 5


def test_asof_null_keys_match_nothing(spark):
    cols = "symbol string, ts long, v int"
    left = spark.createDataFrame([(None, 5, 1), ("A", None, 2), ("A", 5, 3)], cols)
    right = spark.createDataFrame([(None, 1, 7), ("A", None, 8), ("A", 2, 9)], "symbol string, ts long, w int")
    got = joins.asof_join(left, right, ["symbol"], ["w"], how="left").collect()
    assert {r.v: r.w for r in got} == {1: None, 2: None, 3: 9}


@pytest.mark.parametrize("limit,broadcast", [(10, True), (1, False)])
def test_lookup_checks_size(spark, df, limit, broadcast):
    dim = spark.createDataFrame([("A", "first"), ("B", "second")], "symbol string, label string")
    hint = joins.lookup_join(df, dim, ["symbol"], max_rows=limit)
    assert hint.count() == df.where("symbol IN ('A', 'B')").count()
    plan = hint._jdf.queryExecution().logical().toString()
    assert ("ResolvedHint (strategy=broadcast)" in plan) == broadcast


# --- ranks, late rows, change logs --------------------------------------------------

@pytest.mark.parametrize("keys", [["symbol"], []])
def test_percentiles(df, rows, keys):
    q = {"p0": 0, "p1": 1, "p50": 50, "p99": 99, "p100": 100}
    got = ranking.percentiles(df, keys, "price", q).collect()
    groups = _by_key(rows) if keys else {None: rows}
    assert len(got) == len(groups)
    for r in got:
        v = sorted(x[2] for x in groups[r.symbol if keys else None])
        n = len(v)
        for name, p in q.items():
            assert r[name] == v[min(n * p // 100, n - 1)]


def test_percentiles_with_few_values(spark):
    df = spark.range(50_000).select(F.lit("k").alias("k"), (F.col("id") % 3).cast("double").alias("v"))
    row = ranking.percentiles(df, ["k"], "v", {"p50": 50, "p99": 99}).first()
    assert (row.p50, row.p99) == (1.0, 2.0)


def test_percentiles_narrow_brackets(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("v"))
    vals = sorted(i * 7919 % 100_003 for i in range(100_000))
    row = ranking.percentiles(df, [], "v", {"p1": 1, "p50": 50, "p99": 99}).first()
    assert (row.p1, row.p50, row.p99) == (vals[1_000], vals[50_000], vals[99_000])


def test_recent_n(df, rows):
    got = ranking.recent_n(df, 3, ["ts", "id"], ["symbol"]).collect()
    want = {r[0] for rs in _by_key(rows).values() for r in rs[-3:]}
    assert {r.id for r in got} == want
    assert [r.id for r in ranking.recent_n(df, 2, ["ts", "id"]).collect()] == [
        r[0] for r in sorted(rows, key=lambda r: (r[4], r[0]))[-1:-3:-1]
    ]


@pytest.mark.parametrize("width", [1, 10, 1_000])
def test_late_rows(df, rows, width):
    t = df.withColumn("run", F.floor(F.col("id") / width).cast("long")).withColumn(
        "wide", F.floor(F.col("run") / 7).cast("long"))
    ok, behind = late.split_late(t, ["id"], ["wide", "run"], 1_000)
    top, want = None, set()
    for r in rows:
        if top is not None and r[4] < top - 1_000:
            want.add(r[0])
        top = r[4] if top is None else max(top, r[4])
    assert {r.id for r in behind.collect()} == want
    assert ok.count() + behind.count() == len(rows)


def test_current_state_and_diff(spark):
    c = spark.createDataFrame(
        [(1, "I", 1, 10.0), (1, "U", 4, 12.0), (2, "I", 2, 5.0), (2, "D", 3, 5.0)],
        "k int, _op string, _lsn long, v double")
    now = current_state(c, ["k"], "_lsn").select("k", "v")
    assert [tuple(r) for r in now.collect()] == [(1, 12.0)]
    was = spark.createDataFrame([(1, 10.0), (3, 1.0), (4, None)], "k int, v double")
    new = spark.createDataFrame([(1, 12.0), (4, None), (5, 2.0)], "k int, v double")
    assert {tuple(r) for r in diff(was, new, ["k"]).collect()} == {
        (1, "-U", 10.0), (1, "+U", 12.0), (3, "-D", 1.0), (5, "+I", 2.0)
    }
