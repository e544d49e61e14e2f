"""Newest rows and throughput of streams against brute force, for several cuts into micro-batches."""

import datetime
import random

import pytest
from pyspark.sql import types as T

from tidemark.operators import ranking
from tidemark.streaming import emit, newest

ROW = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("id", T.LongType()), T.StructField("ts", T.LongType()),
    T.StructField("price", T.DoubleType()), T.StructField("seen", T.TimestampType()),
])


def _rows(n=240, seed=3):
    """One symbol holds half of all rows; times repeat and are missing, ids need all 64 bits."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        symbol = r.choice(["HOT", "HOT", "HOT", "B", None, "c\"d"])
        ts = None if i % 17 == 0 else r.randrange(0, 40)
        price = r.choice([None, 1.5, float("nan"), -0.25])
        seen = datetime.datetime(2024, 1, 1, 0, 0, 0, r.randrange(10**6))
        rows.append((symbol, 2**62 + i // 2 if i % 5 else None, ts, price, seen))
    return rows + rows[:20]


def _live(spark, folder, rows, cuts):
    size = -(-len(rows) // cuts) or 1
    path = f"{folder}/in-{cuts}"
    spark.createDataFrame([], ROW).write.parquet(path)
    for i in range(cuts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], ROW).repartition(2).write.mode("append").parquet(path)
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", max(2, 2 * cuts // 3)).parquet(path)


def _place(x):
    return (0, 0) if x is None else (1, x)


def _plain(x):
    return "nan" if isinstance(x, float) and x != x else x


@pytest.mark.parametrize("cuts", [1, 6])
def test_recent_per_key(spark, folder, cuts):
    rows = _rows()
    out = emit.on_update(newest.stream_recent(_live(spark, folder, rows, cuts), 7, ["ts", "id"], ["symbol"]), "r", f"{folder}/o", mode="append")
    got = {}
    for r in emit.final_rows(out, ["symbol", "rank"]).collect():
        got.setdefault(r["symbol"], {})[r["rank"]] = tuple(_plain(r[c]) for c in ROW.names)
    assert set(got) == {r[0] for r in rows}
    for symbol, places in got.items():
        mine = sorted((r for r in rows if r[0] == symbol), key=lambda r: (_place(r[2]), _place(r[1])), reverse=True)
        assert sorted(places) == list(range(1, min(7, len(mine)) + 1))
        # Rows of one time and id may stand in either order; the orders themselves are one.
        assert [places[k][1:3] for k in sorted(places)] == [r[1:3] for r in mine[:7]]
        every = [tuple(map(_plain, r)) for r in mine]
        for row in places.values():
            every.remove(row)


def test_recent_over_all_rows_ties_and_repeats(spark, folder):
    same = ("A", 1, 5, 1.5, None)
    rows = [same, ("A", 1, 5, 2.5, None), same, ("B", None, None, None, None), same]
    lists = []
    for cuts in (1, 3):
        out = emit.on_update(newest.stream_recent(_live(spark, f"{folder}/{cuts}", rows, cuts), 4, ["ts"]), "a", f"{folder}/o{cuts}", mode="append")
        now = emit.final_rows(out, ["rank"]).orderBy("rank").collect()
        lists.append([(r["rank"], r["price"]) for r in now])
    assert lists[0] == lists[1] == [(1, 2.5), (2, 1.5), (3, 1.5), (4, 1.5)]


def test_throughput_keeps_the_newest_ticks(spark, folder):
    rows = _rows(seed=4)
    out = emit.on_update(newest.stream_throughput(_live(spark, folder, rows, 5), ["symbol"], 10, last=3), "t", f"{folder}/o", mode="append")
    got = {(r["symbol"], r["rank"]): (r["tick"], r["rows"]) for r in emit.final_rows(out, ["symbol", "rank"]).collect()}
    want = {}
    for symbol in {r[0] for r in rows}:
        ticks = {}
        for r in rows:
            if r[0] == symbol:
                tick = None if r[2] is None else r[2] // 10 * 10
                ticks[tick] = ticks.get(tick, 0) + 1
        best = sorted(ticks.items(), key=lambda x: _place(x[0]), reverse=True)[:3]
        want |= {(symbol, i + 1): x for i, x in enumerate(best)}
    assert got == want


def test_latest_takes_streams(spark, folder):
    rows = _rows(seed=5)
    live = ranking.latest_by_key(_live(spark, folder, rows, 4), ["symbol"], ["ts", "id"], ["ts", "id"])
    now = emit.final_rows(emit.on_update(live, "l", f"{folder}/o"), ["symbol"])
    got = {r["symbol"]: (r["ts"], r["id"]) for r in now.collect()}
    assert got == {
        s: max(((r[2], r[1]) for r in rows if r[0] == s), key=lambda x: (_place(x[0]), _place(x[1]))) for s in {r[0] for r in rows}
    }


def test_empty_stream_and_refusals(spark, folder):
    out = emit.on_update(newest.stream_recent(_live(spark, folder, [], 1), 3, ["ts"], ["symbol"]), "e", f"{folder}/o", mode="append")
    assert out.count() == 0 and out.columns == ["symbol", "rank", "id", "ts", "price", "seen", "batch_id"]
    live = _live(spark, f"{folder}/x", [], 1)
    with pytest.raises(ValueError):
        newest.stream_recent(live, 0, ["ts"])
    with pytest.raises(ValueError):
        newest.stream_recent(live.withColumnRenamed("id", "rank"), 3, ["ts"])
