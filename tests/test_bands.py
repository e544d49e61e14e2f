"""Band joins of two streams by chunks."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.functions.time import with_event_time
from tidemark.operators import joins
from tidemark.plans import fraud
from tidemark.sinks.tables import stream_to_table
from tidemark.sources import files
from tidemark.streaming import bands, emit, native

T0 = 1_700_000_000_000
LEFT = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("ts", T.LongType())])
RIGHT = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("rid", T.LongType()), T.StructField("name", T.StringType()), T.StructField("ts", T.LongType())])


def _rows(n, seed, third):
    """Most rows in one dense bucket, some keys, times and values null, every tenth row twice."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        ts = T0 + (k * 10 if k % 3 else k * 100 + rng.randrange(50))
        row = (rng.choice(["A", "A", "A", "B", None]), k if k % 7 else None, third(k), None if k % 31 == 5 else ts)
        rows += [row] * (2 if k % 10 == 0 else 1)
    return rows


L = _rows(600, 1, lambda k: None if k % 13 == 0 else k / 8)
R = _rows(600, 2, lambda k: None if k % 11 == 0 else f"N{k}")


def _live(spark, folder, rows, schema, cuts=4):
    size = -(-len(rows) // cuts)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).repartition(2).write.mode("append").parquet(folder)
    return emit.watermark(with_event_time(files.read_stream(spark, folder, schema, max_files=2)), "1 minute")


def _table(spark, rows, schema):
    return with_event_time(spark.createDataFrame(rows, schema))


SELECT = ["l.id", "l.symbol", "l.price", "r.rid", "r.name", "l.ts - r.ts AS age"]


@pytest.mark.parametrize("lower,upper,bucket,where", [(-200, 200, None, None), (-500, 0, 350, "l.price >= r.rid / 8")])
def test_matches_of_streams_are_those_of_tables(spark, folder, monkeypatch, lower, upper, bucket, where):
    monkeypatch.setattr(bands, "ROWS", 16)
    monkeypatch.setattr(bands, "SORTED", 100)
    l, r = _live(spark, f"{folder}/l", L, LEFT), _live(spark, f"{folder}/r", R, RIGHT)
    flat = joins.band_join(_table(spark, L, LEFT), _table(spark, R, RIGHT), ["symbol"], lower, upper, SELECT, bucket=bucket, where=where)
    want = sorted(map(tuple, flat.collect()), key=repr)
    assert len(want) > 1_000
    for nested in (False, True):
        live = joins.band_join(l, r, ["symbol"], lower, upper, SELECT, bucket=bucket, where=where, nested=nested)
        got = emit.on_close(live, "j", f"{folder}/{nested}")
        assert got.columns == flat.columns and got.dtypes == flat.dtypes
        assert sorted(map(tuple, got.collect()), key=repr) == want


def _progress(spark, df, folder):
    with emit.stream_settings(spark):
        query = stream_to_table(df, f"{folder}/data", f"{folder}/checkpoint")
        query.awaitTermination()
    return query.recentProgress


def test_state_and_pairs_are_chunks(spark, folder):
    """A busy bucket is a few rows of the join, and its matches are written as a few nested rows."""
    dense = [("A", k, 1.0, T0 + k) for k in range(3_000)]
    l = _live(spark, f"{folder}/l", dense, LEFT, 1)
    r = _live(spark, f"{folder}/r", [("A", k, "N", T0 + k) for k in range(3_000)], RIGHT, 1)
    found = joins.band_join(l, r, ["symbol"], -600_000, 600_000, ["l.id", "r.rid"], nested=True)
    seen = _progress(spark, found.found, f"{folder}/out")
    assert max(s.numRowsTotal for p in seen for s in p.stateOperators) < 20
    table = spark.read.parquet(f"{folder}/out/data")
    assert table.count() < 20 and found.unnested(table).count() == 9_000_000


def test_newest_match_meets_few_candidates(spark, folder):
    """Candidates of a left row are one a chunk, not all rows in the band."""
    rows = [("A", k, 1.0, T0 + k) for k in range(2_000)]
    l = _live(spark, f"{folder}/l", [*rows, ("Z", 0, 1.0, T0 + 10_000_000)], LEFT, 1)
    r = _live(spark, f"{folder}/r", [*[("A", k % 1_000, f"N{k}", T0 + k // 2) for k in range(2_000)], ("Z", 0, "N", T0 + 10_000_000)], RIGHT, 1)
    made = bands.band_newest(l, r, ["symbol"], -600_000, 0, 600_000, ["id", "ts"], ["ts", "name"], "ts", "event_time", "rid")
    seen = _progress(spark, made, f"{folder}/made")
    assert spark.read.parquet(f"{folder}/made/data").count() <= 2 * 2_001
    assert max(s.numRowsTotal for p in seen for s in p.stateOperators) < 20
    out = emit.on_close(native.stream_asof_band(l, r, ["symbol"], ["name"], "id", "10 minutes", "rid"), "q", f"{folder}/out")
    # Two rows of R are at each instant; the larger rid wins, and 999 is followed by 0.
    newest = lambda k: max((2 * k, 2 * k + 1), key=lambda j: j % 1_000)
    assert {(x.id, x.name) for x in out.where("id > 0 OR name <> 'N'").collect()} == {(k, f"N{newest(min(k, 999))}") for k in range(2_000)}


def test_detection_matches_are_written_nested(spark, folder):
    """The six streams write the matches of a band as few rows, and return all of them."""
    l, r = _live(spark, f"{folder}/l", L, LEFT), _live(spark, f"{folder}/r", R, RIGHT)
    side = [F.lit("A-1").alias("account_id"), F.lit("buy").alias("side"), "event_time"]
    trades = l.select("symbol", "price", F.col("id").alias("volume"), "ts", F.col("id").alias("seq"), *side)
    orders = r.select("symbol", "ts", F.col("rid").alias("order_no"), F.col("name").alias("order_id"), F.lit(1.0).alias("price"), *side)
    streams = fraud.detection_streams(
        trades, orders, hop_size="2 seconds", hop_slide="1 second", bar="1 second", burst_gap="1 second", wash="1 second",
        match="1 second", order="seq", segment="1 hour", nested=True)
    out = emit.on_close_all({"suspicious_match": streams["suspicious_match"]}, "d", f"{folder}/out")["suspicious_match"]
    flat = joins.band_join(_table(spark, L, LEFT), _table(spark, R, RIGHT), ["symbol"], -1_000, 1_000, ["l.price", "r.name"])
    assert sorted(map(tuple, out.select("trade_price", "order_id").collect()), key=repr) == sorted(map(tuple, flat.collect()), key=repr)
    assert spark.read.parquet(f"{folder}/out/suspicious_match/data").count() * 100 < flat.count()
