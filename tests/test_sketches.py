"""Percentiles from mergeable sketches."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import measures as M
from tidemark.functions.time import with_event_time
from tidemark.operators import ranking
from tidemark.operators.windows import hop_agg, session_agg, tumble_agg

PERCENT = {"p10": 10, "p50": 50, "p99": 99}


def _trades(spark, rows):
    return with_event_time(spark.createDataFrame(rows, "symbol string, price double, ts long")).repartition(5)


def _skewed(n=30_000):
    r = random.Random(8)
    return [("HOT" if i % 10 else "B", r.choice([5.0, r.lognormvariate(0, 3)]), r.randrange(0, 60_000)) for i in range(n)]


def test_hop_panes_merge_within_the_bound(spark):
    t = _trades(spark, _skewed())
    got = hop_agg(t, ["symbol"], "20 seconds", "5 seconds", [M.quantiles("price", "q", PERCENT)]).select("symbol", "bar_start", "q.*")
    rows = t.select("symbol", F.unix_millis(F.window("event_time", "20 seconds", "5 seconds")["start"]).alias("bar_start"), "price")
    exact = {(r[0], r[1]): tuple(r[2:]) for r in rows.groupBy("symbol", "bar_start").agg(
        F.count("price"), F.min("price"), F.max("price")).collect()}
    found = ranking.rank_errors(rows, got, ["symbol", "bar_start"], "price", PERCENT).collect()
    assert {(r["symbol"], r["bar_start"]): (r["n"], r["low"], r["high"]) for r in found} == exact
    assert max(r[f"{p}_error"] for r in found for p in PERCENT) <= 0.01


def test_errors_are_measured(spark):
    rows = spark.createDataFrame([("A", float(v)) for v in range(1, 101)], "k string, v double")
    off = spark.createDataFrame([("A", 50.0, 90.0), ("Z", 1.0, 1.0)], "k string, p50 double, p99 double")
    got = {r["k"]: r for r in ranking.rank_errors(rows, off, ["k"], "v", {"p50": 50, "p99": 99}).collect()}
    assert got["A"]["p50_error"] == 0 and abs(got["A"]["p99_error"] - 0.09) < 1e-9
    assert got["Z"]["p50_error"] is None


def test_small_groups_are_exact_nulls_and_nan_left_out(spark):
    rows = [("A", float(v), v) for v in range(1, 101)] + [("A", None, 5), ("A", float("nan"), 6), ("N", None, 7)]
    got = {r["symbol"]: r["q"] for r in tumble_agg(
        _trades(spark, rows), ["symbol"], "1 second", [M.quantiles("price", "q", PERCENT)]).collect()}
    assert got["N"] is None
    a = got["A"]
    assert (a["n"], a["low"], a["high"]) == (100, 1.0, 100.0)
    assert [a[p] for p in PERCENT] in ([10.0, 50.0, 99.0], [11.0, 51.0, 100.0])


def test_sessions_and_empty_tables(spark):
    m = [M.quantiles("price", "q", PERCENT)]
    one = session_agg(_trades(spark, [("A", float(v), v * 400) for v in range(1, 50)]), ["symbol"], "1 second", m).collect()
    assert len(one) == 1 and one[0]["q"]["n"] == 49 and one[0]["q"]["high"] == 49.0
    assert hop_agg(_trades(spark, []), ["symbol"], "20 seconds", "5 seconds", m).count() == 0


def test_a_sketch_is_not_folded_row_by_row():
    with pytest.raises(ValueError):
        M.row_partials([M.Measure("q", (M.Part("k", None, None, None, None),), None)])
