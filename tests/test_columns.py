import math
import random
import struct
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import json_codec, sql
from tidemark.functions.numbers import round4
from tidemark.functions.time import interval_ms, start_ms, tumble, window_start, with_event_time
from tidemark.plans import registry
from tidemark.schemas import TRADES
from tidemark.sources import cdc, kafka as kafka_source


@pytest.mark.parametrize("span,ms", [
    ("5 seconds", 5_000), ("1 MINUTE", 60_000), ("1 hour 30 minutes", 5_400_000),
    ("-10 minutes", -600_000), ("250 milliseconds", 250), (timedelta(seconds=2), 2_000), (7, 7),
])
def test_interval(span, ms):
    assert interval_ms(span) == ms


@pytest.mark.parametrize("span", ["five seconds", "5 fortnights", "5"])
def test_bad_interval(span):
    with pytest.raises(ValueError):
        interval_ms(span)


def test_round4_is_round_to_the_bit(spark):
    """Also halfway between two results, next to it, and for values that aren't numbers."""
    rng = random.Random(4)
    near = [math.nextafter(v, to) for v in (0.00005, 1.00005, -2.71825, 12345.67895) for to in (-math.inf, math.inf)]
    halves = [(2 * rng.randrange(-10**9, 10**9) + 1) / 20_000 for _ in range(2_000)]
    spread = [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 13) for _ in range(4_000)]
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -0.00001, 0.00005, -0.00005, 1e8, 999_999_999.99995, 1e9, -1e15, 1e300, 5e-324]
    df = spark.createDataFrame([(v,) for v in [*near, *halves, *spread, *odd]], "x double")
    bits = lambda v: None if v is None else struct.pack(">d", v)
    rows = df.select("x", F.round("x", 4).alias("want"), round4(F.col("x")).alias("got")).collect()
    assert [r for r in rows if bits(r.want) != bits(r.got)] == []


def test_row_window_start_equals_grouped_window_start(spark):
    df = with_event_time(spark.range(-20_000, 20_000, 777).withColumnRenamed("id", "ts"))
    got = df.select(
        window_start("ts", "5 seconds").alias("a"), tumble("5 seconds").alias("window")
    ).select("a", start_ms().alias("b"))
    assert got.where("a <> b").count() == 0


def test_sql_tumble_keeps_milliseconds(spark):
    sql.register(spark)
    row = spark.sql("SELECT CAST(tumble(12345, INTERVAL '5' SECOND) AS BIGINT) AS s").first()
    assert row.s == 10_000


def test_json_round_trip_and_bad_payload(spark):
    rows = spark.createDataFrame([("AAPL", 150.5, 10, 1000)], TRADES)
    sent = json_codec.encode(rows, "symbol")
    assert sent.first().value == '{"symbol":"AAPL","price":150.5,"volume":10,"ts":1000}'
    assert json_codec.decode(sent, TRADES).collect() == rows.collect()
    bad = json_codec.decode(spark.createDataFrame([("{oops",)], "value string"), TRADES)
    assert bad.where(F.col("symbol").isNull()).count() == 1


def test_text_is_parsed_once_a_row(spark):
    """Not once for every column and every test of a NOT NULL column."""
    records = spark.createDataFrame([('{"symbol": "A", "price": 1.5, "volume": 2, "ts": 3}',), ("{oops",), (None,)], "value string")
    rows = kafka_source.decode_json(records)
    assert [tuple(r)[:4] for r in rows.collect()] == [("A", 1.5, 2, 3)]
    image = '{"id": 1, "customer_id": 2, "amount": 0.5, "status": "s", "ts": 4}'
    log = spark.createDataFrame(
        [("o", "I", 1, 2, None, image), ("o", "D", 2, 3, image, None), ("o", "U", 3, 4, image, None), ("o", "U", 4, 5, None, "{")],
        "_table string, _op string, _lsn long, _ts_ms long, _before string, _after string")
    changes = cdc.decode_envelope(log).where("customer_id IS NULL OR amount > 0")
    seen, none = (1, 2, 0.5, "s", 4), (None,) * 5
    assert [tuple(r)[4:] for r in changes.orderBy("_lsn").collect()] == [seen, seen, none, none]
    for df in (rows, changes):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_current_rows_keep_only_what_is_shown(spark, monkeypatch):
    """The state and every emission hold the newest image of each customer, so it is cut to the columns in use."""
    image = '{"id": 1, "customer_id": 2, "amount": 0.5, "status": "s", "ts": 4}'
    log = spark.createDataFrame([("o", "I", 1, 2, None, image)], "_table string, _op string, _lsn long, _ts_ms long, _before string, _after string")
    monkeypatch.setattr(registry.tables, "order_envelopes", lambda *args: log)
    kept = []
    monkeypatch.setattr(registry.emit, "keep_current", lambda changes, *args: kept.append(changes.columns) or changes)
    assert [tuple(r) for r in registry.stream_current(spark, "").collect()] == [(2, 1, 0.5, "I")]
    assert sorted(kept[0]) == ["_lsn", "_op", "amount", "customer_id", "id"]
