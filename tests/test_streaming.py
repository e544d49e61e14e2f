"""Streams over several micro-batches against the batch form or brute force."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.functions import json_codec, measures as M
from tidemark.functions.time import with_event_time
from tidemark.operators.windows import session_agg, tumble_agg
from tidemark.plans import cdc, market
from tidemark.schemas import CDC_ENVELOPE, KAFKA_RECORD, LOG_LINE, ORDERS, TRADES
from tidemark.sinks import foreach, kafka as kafka_sink, tables as table_sink
from tidemark.sources import cdc as cdc_source, files, kafka as kafka_source
from tidemark.streaming import emit, lateness, native, sessions, stateful
from tidemark.streaming.metrics import source_metrics
from tidemark.streaming.progress import PROGRESS, progress_row

SYMBOLS = ["AAPL", "GOOGL", "MSFT", "AMZN", "TSLA"]
END = ("ZZZ", 1.0, 1, 10_000_000)


# A stream starts with watermark 0, so times start later than that.
T0 = 1_000_000


def _batch(start, n=30):
    return [
        (SYMBOLS[i % 5], 100.0 + (i * 37 + start) % 50, 10 + i, T0 + start + i * 400)
        for i in range(n)
    ]


BATCHES = [_batch(0), _batch(12_000), _batch(24_000), [END]]
ALL = [r for b in BATCHES for r in b]


def _feed(spark, folder, batches, schema):
    """One file per micro-batch, in order."""
    path = f"{folder}/in"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.mode("append").parquet(path)
        for name in os.listdir(path):
            full = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(full) > 2_000_000:
                os.utime(full, (1_000_000 + i, 1_000_000 + i))
    return path


def _live(spark, folder, batches=BATCHES, schema=TRADES, delay="1 second"):
    path = _feed(spark, folder, batches, schema)
    df = files.source(files.read_stream(spark, path, schema, max_files=1), schema)
    return emit.watermark(df, delay)


def _table(spark, rows=ALL, schema=TRADES):
    return with_event_time(spark.createDataFrame(rows, schema))


# Trades whose fields may be missing.
NULLABLE = T.StructType([T.StructField(f.name, f.dataType, True) for f in TRADES.fields])


def _same(a, b):
    cols = sorted(a.columns)
    return sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def _without_end(df):
    return df.where("symbol <> 'ZZZ'")


@pytest.mark.parametrize("plan", [
    lambda t: market.ohlc_full(t, "5 seconds", "ts"),
    lambda t: market.hop_volume(t, "10 seconds", "2 seconds"),
    lambda t: market.session_burst(t, "1 second"),
    lambda t: market.ohlc_cascade(t, "5 seconds", "10 seconds", "ts"),
], ids=["tumble", "hop", "session", "cascade"])
def test_windows_on_close(spark, folder, plan):
    out = emit.on_close(plan(_live(spark, folder)), "w", f"{folder}/out")
    assert _same(_without_end(out), _without_end(plan(_table(spark))))


def test_hop_panes_on_a_stream(spark, folder):
    ms = [M.total("volume", "v"), M.count_rows("n")]
    from tidemark.operators.windows import hop_agg

    live = hop_agg(_live(spark, folder), ["symbol"], "10 seconds", "2 seconds", ms, panes=True)
    flat = hop_agg(_table(spark), ["symbol"], "10 seconds", "2 seconds", ms)
    assert _same(_without_end(emit.on_close(live, "p", f"{folder}/out")), _without_end(flat))


def test_update_mode_ends_at_the_batch_result(spark, folder):
    out = emit.on_update(market.ohlc_full(_live(spark, folder), "5 seconds", "ts"), "u", f"{folder}/out")
    assert out.select("batch_id").distinct().count() >= 4 and out.where("batch_id < 0").count() == 0
    final = emit.final_rows(out, ["symbol", "bar_start"])
    assert _same(final, market.ohlc_full(_table(spark), "5 seconds", "ts"))


def test_late_rows_are_dropped_and_counted(spark, folder):
    base = 1_000_000
    batches = [
        [("AAPL", 150.0, 100, base + i * 500) for i in range(5)],
        [("MSFT", 420.0, 50, base + 200_000)],
        [("LATE", 99.0, 1, base - 60_000 + i * 100) for i in range(3)],
        [("MSFT", 420.0, 50, base + 300_000)],
        [END],
    ]
    live = market.window_counts(_live(spark, folder, batches), "5 seconds")
    query = emit.drain(
        spark, lambda: table_sink.stream_to_table(live, f"{folder}/out", f"{folder}/ck"))
    seen = {r.symbol for r in spark.read.parquet(f"{folder}/out").collect()}
    assert seen >= {"AAPL", "MSFT"} and "LATE" not in seen
    log = spark.createDataFrame([progress_row(json.loads(p.json)) for p in query.recentProgress], PROGRESS)
    assert log.agg(F.sum("groups_dropped_late")).first()[0] > 0
    assert log.agg(F.sum("rows_in")).first()[0] == 11


ORDER_ROWS = [
    [(f"O{b}{i}", SYMBOLS[i % 5], "buy", 5, 100.0 + i, T0 + 12_000 * b + i * 700) for i in range(15)]
    for b in range(3)
] + [[("OZ", "ZZZ", "buy", 1, 1.0, 10_000_000)]]


def test_band_join_across_batches(spark, folder):
    live = market.trade_order_match(
        _live(spark, f"{folder}/t"), _live(spark, f"{folder}/o", ORDER_ROWS, ORDERS),
        "-2 seconds", "2 seconds",
    )
    flat = market.trade_order_match(
        _table(spark), _table(spark, [r for b in ORDER_ROWS for r in b], ORDERS),
        "-2 seconds", "2 seconds",
    )
    assert flat.count() > 50
    assert _same(emit.on_close(live, "j", f"{folder}/out"), flat)


def _orders_side(df):
    return df.select("symbol", "order_id", F.col("price").alias("order_price"), "ts", "event_time")


def test_asof_forms_across_batches(spark, folder):
    from tidemark.operators.joins import asof_join

    orders = [r for b in ORDER_ROWS for r in b]
    cols = ["order_id", "order_price"]
    t, o = _live(spark, f"{folder}/t"), _orders_side(_live(spark, f"{folder}/o", ORDER_ROWS, ORDERS))
    live = stateful.stream_asof(t, o, ["symbol"], cols)
    flat = asof_join(_table(spark), _orders_side(_table(spark, orders, ORDERS)).drop("event_time"),
                     ["symbol"], cols).drop("event_time")
    out = emit.on_close(live, "a", f"{folder}/out")
    assert flat.count() > 80
    assert _same(_without_end(out), _without_end(flat))

    left = emit.on_close(
        stateful.stream_asof(t, o, ["symbol"], cols, how="left"), "l", f"{folder}/out3")
    assert _same(left.where("match_ts IS NOT NULL"), out)
    assert left.count() == len(ALL) - 1

    band = native.stream_asof_band(t, o, ["symbol"], cols, "volume", "1 second", left_cols=["price"])
    near = asof_join(_table(spark), _orders_side(_table(spark, orders, ORDERS)).drop("event_time"),
                     ["symbol"], cols, tolerance="1 second").drop("event_time")
    got = emit.on_close(band, "b", f"{folder}/out2")
    assert _same(_without_end(got), _without_end(near))


def test_lag_and_lead_continue_across_batches(spark, folder):
    t = _live(spark, folder)
    lag = emit.on_close(
        stateful.stream_lag(t, ["symbol"], "price", "prev_price", ["ts"], -1.0), "l", f"{folder}/lag")
    assert _same(_without_end(lag), _without_end(market.lag_price(_table(spark)).drop("event_time")))
    assert _without_end(lag).where("prev_price = -1.0").count() == 5
    lead = emit.on_close(
        stateful.stream_lead(t, ["symbol"], "price", "next_price", ["ts"], -1.0, "1 hour"),
        "d", f"{folder}/lead")
    flat = market.lead_price(_table(spark)).drop("event_time")
    assert _same(_without_end(lead), _without_end(flat))


def test_one_key_uses_several_tasks(spark, folder):
    batches = [[("AAPL", float(i), 1, T0 + 500 * i) for i in range(a, a + 60)] for a in (0, 60)]
    t = _live(spark, folder, [*batches, [END]])
    out = emit.on_close(
        stateful.stream_lag(t, ["symbol"], "price", "prev_price", ["ts"], -1.0, segment="4 seconds"),
        "h", f"{folder}/out")
    assert out.where("symbol = 'AAPL' AND prev_price = price - 1").count() == 120
    parts = out.where("symbol = 'AAPL'").groupBy(F.input_file_name().alias("f")).count()
    # Three micro-batches hand rows out; one task each would write three files.
    assert parts.count() > 6 and parts.agg(F.max("count")).first()[0] < 60


def test_per_batch_lag_starts_again(spark, folder):
    path = _feed(spark, folder, BATCHES[:3], TRADES)
    raw = files.read_stream(spark, path, TRADES, max_files=1)
    emit.drain(spark, lambda: native.per_batch_lag(
        raw, ["symbol"], ["ts"], "price", "prev_price", -1.0, f"{folder}/out", f"{folder}/ck"))
    out = spark.read.parquet(f"{folder}/out")
    assert out.where("prev_price = -1.0").count() == 15


def test_session_updates_merge(spark, folder):
    batches = [
        [("A", 1.0, 1, T0), ("A", 2.0, 2, T0 + 500), ("B", 5.0, 9, T0)],
        [("A", 3.0, 4, T0 + 4_000)],
        [("A", 0.5, 8, T0 + 2_300)],
    ]
    live = _live(spark, folder, batches, delay="1 minute")
    changes = sessions.stream_session_updates(live, ["symbol"], 2_000, market.burst_measures())
    out = emit.on_update(changes, "s", f"{folder}/out", mode="append")
    log = sorted((r.batch_id, r.change, r.session_start - T0, r.burst_trades)
                 for r in out.where("symbol = 'A'").collect())
    assert log == [(0, "+U", 0, 2), (1, "+U", 4_000, 1), (2, "+U", 0, 4), (2, "-D", 4_000, 1)]
    live_now = emit.final_rows(out, ["symbol", "session_start"]).where("change = '+U'")
    assert {tuple(r) for r in live_now.drop("change").collect()} == {
        ("A", T0, T0 + 4_000, 4, 15, 0.5, 3.0), ("B", T0, T0, 1, 9, 5.0, 5.0)}


def _any_measures():
    return [
        M.count_rows("n"), M.mean("price", "mean"), M.value_range("price", "range"), M.opening("price", "open", "volume"),
        M.closing("price", "close", "volume"), M.total_if(F.col("price") > 50, "volume", "dear"), M.notional(),
    ]


@pytest.mark.parametrize("cuts", [1, 8])
def test_session_updates_of_any_measures(spark, folder, cuts):
    """Long and short sessions of a busy key over the ends of blocks, in shuffled order."""
    rng = random.Random(9)
    times, t = [], T0
    for _ in range(400):
        t += rng.choice([1, 300, 900, 1_000, 1_001, 2_500, 30_000])
        times.append(t)
    rows = [("A" if i % 4 else "B", float(rng.randint(1, 100)), i, x) for i, x in enumerate(times)]
    fed = rows[:]
    rng.shuffle(fed)
    size = -(-len(fed) // cuts)
    live = _live(spark, folder, [fed[k : k + size] for k in range(0, len(fed), size)], delay="1 day")
    changes = sessions.stream_session_updates(live, ["symbol"], 1_000, _any_measures(), cells_per_block=8)
    out = emit.on_update(changes, "s", f"{folder}/out", mode="append")
    last = emit.final_rows(out, ["symbol", "session_start"]).where("change = '+U'").drop("change")
    want = session_agg(_table(spark, rows), ["symbol"], 1_000, _any_measures())
    _same(last, want.select(*last.columns))
    # No change is told twice in a micro-batch.
    assert out.groupBy("batch_id", "symbol", "session_start").count().where("count > 1").isEmpty()


def test_sessions_of_one_key_use_several_tasks(spark, folder):
    rows = [("A", 1.0, 1, T0 + k * 5_000) for k in range(200)]
    live = _live(spark, folder, [rows], delay="1 day").withColumn("task", F.spark_partition_id())
    changes = sessions.stream_session_updates(live, ["symbol"], 2_000, [M.count_rows("n")], cells_per_block=16)
    told = emit.on_update(changes.withColumn("task", F.spark_partition_id()), "s", f"{folder}/out", mode="append")
    assert told.count() == 200 and told.select("task").distinct().count() > 2


def test_late_rows_kept_aside_for_any_cut(spark, folder):
    rng = random.Random(4)
    rows = [("A", float(k), k, None if k == 7 else T0 + k * 100 - rng.choice([0, 0, 0, 5_000, 20_000])) for k in range(300)]
    high, want = None, set()
    for row in rows:
        if high is not None and row[3] is not None and row[3] < high - 3_000:
            want.add(row[2])
        high = max(x for x in (high, row[3]) if x is not None)
    for cuts in (1, 8, 40):
        size = -(-len(rows) // cuts)
        path = f"{folder}/{cuts}"
        os.makedirs(path)
        feed = _feed(spark, path, [rows[k : k + size] for k in range(0, len(rows), size)], NULLABLE)
        live = files.read_stream(spark, feed, NULLABLE, max_files=1).withColumn("run", F.floor(F.col("volume") / 16))
        split = lateness.split_stream(live, ["volume"], ["run"], "3 seconds", "late", f"{path}/out")
        got = lateness.parted(spark, split, live.schema)
        late = {r.volume for r in got.where("is_late").collect()}
        on_time = [r.volume for r in got.where("NOT is_late").collect()]
        assert late == want and sorted([*late, *on_time]) == list(range(300))
        counts = lateness.marks(spark, split).collect()
        assert len(counts) == -(-300 // size) and sum(r.rows_in for r in counts) == 300
        assert sum(r.rows_late for r in counts) == len(want) and max(r.high_water for r in counts) == max(r[3] for r in rows if r[3])
    behind = lateness.on_time_stream(spark, split, live.schema)
    assert emit.on_update(behind.groupBy().count(), "n", f"{folder}/n", complete=True).first()[0] == 300 - len(want)


def test_late_rows_of_a_repeated_micro_batch(spark, folder):
    rows = [("A", 1.0, k, T0 + k) for k in range(10)] + [("A", 1.0, 10, T0 - 9_000)]
    batch = _table(spark, rows).drop("event_time").withColumn("run", F.lit(0))
    live = files.read_stream(spark, _feed(spark, folder, [rows], TRADES), TRADES).withColumn("run", F.lit(0))
    split = lateness.split_stream(live, ["volume"], ["run"], "3 seconds", "late", f"{folder}/out")
    for _ in range(2):
        lateness._part(split, ["volume"], ["run"], "3 seconds", "ts")(batch, 0)
    assert lateness.parted(spark, split, batch.schema).count() == 11
    assert [tuple(r) for r in lateness.marks(spark, split).collect()] == [(11, 1, T0 + 9, 0)]


def test_changelog(spark, folder):
    path = _feed(spark, folder, [[("A", 1.0, 5, 0), ("B", 1.0, 7, 0)], [("A", 1.0, 3, 1)]], TRADES)
    live = files.read_stream(spark, path, TRADES, max_files=1)
    totals = {"v": ("sum", "volume"), "n": ("count", "volume"), "last": ("max", "ts")}
    out = emit.emit_changes(live, ["symbol"], totals, "c", f"{folder}/out")
    assert {tuple(r) for r in out.select("batch_id", "symbol", "change", "v", "n", "last").collect()} == {
        (0, "A", "+I", 5, 1, 0), (0, "B", "+I", 7, 1, 0), (1, "A", "-U", 5, 1, 0), (1, "A", "+U", 8, 2, 1)}


def test_current_state_of_a_change_stream(spark, folder):
    schema = "k int, _op string, _lsn long, v double"
    batches = [
        [(1, "I", 1, 10.0), (2, "I", 2, 5.0), (3, "I", 3, 7.0)],
        [(1, "U", 6, 12.0), (2, "D", 5, 5.0)],
        [(2, "U", 4, 6.0), (1, "U", 7, 13.0)],
    ]
    typed = spark.createDataFrame([], schema).schema
    path = _feed(spark, folder, batches, schema)
    live = files.read_stream(spark, path, typed, max_files=1)
    now = emit.keep_current(live, ["k"], "_lsn", "s", f"{folder}/out")
    assert sorted((r.k, r.v) for r in now.collect()) == [(1, 13.0), (3, 7.0)]


def test_several_streams_from_one_source(spark, folder):
    t = _live(spark, folder)
    out = emit.on_close_all(
        {"bars": market.ohlc(t, "5 seconds", "ts"), "counts": market.window_counts(t, "5 seconds")},
        "m", f"{folder}/out")
    assert out["bars"].count() == out["counts"].count() > 0


def test_fan_out_restart_adds_nothing(spark, folder):
    path = _feed(spark, folder, BATCHES, TRADES)
    start = lambda: foreach.fan_out(
        files.read_stream(spark, path, TRADES, max_files=1),
        [foreach.table_target(f"{folder}/a"),
         foreach.table_target(f"{folder}/b", transform=lambda b: kafka_sink.encode_json(b, "symbol"))],
        f"{folder}/ck")
    emit.drain(spark, start)
    emit.drain(spark, start)
    assert spark.read.parquet(f"{folder}/a").count() == len(ALL)
    back = json_codec.decode(spark.read.parquet(f"{folder}/b"), TRADES)
    assert sorted(map(tuple, back.collect())) == sorted(ALL)


def test_row_callback(spark, folder):
    out = f"{folder}/seen"
    os.makedirs(out)

    def note(row):
        with open(f"{out}/{row.symbol}-{row.ts}", "w") as f:
            f.write("x")
        return True

    path = _feed(spark, folder, BATCHES[:1], TRADES)
    emit.drain(spark, lambda: foreach.for_each_row(
        files.read_stream(spark, path, TRADES), note, f"{folder}/ck"))
    assert len(os.listdir(out)) == len(BATCHES[0])


def test_row_callback_stops_without_losing_rows(spark, folder):
    path = _feed(spark, folder, BATCHES[:1], TRADES)
    query = foreach.for_each_row(files.read_stream(spark, path, TRADES), lambda row: False, f"{folder}/ck")
    with pytest.raises(Exception):
        query.awaitTermination()
    assert foreach.stopped(query) and not os.listdir(f"{folder}/ck/commits")
    out = f"{folder}/seen"
    os.makedirs(out)

    def note(row):
        with open(f"{out}/{row.symbol}-{row.ts}", "w") as f:
            f.write("x")

    emit.drain(spark, lambda: foreach.for_each_row(files.read_stream(spark, path, TRADES), note, f"{folder}/ck"))
    assert len(os.listdir(out)) == len(BATCHES[0])


def test_update_mode_without_rows(spark, folder):
    out = emit.on_update(market.ohlc_full(_live(spark, folder, [[]]), "5 seconds", "ts"), "u", f"{folder}/out")
    assert out.count() == 0


def test_running_trigger(spark, folder):
    live = market.window_counts(_live(spark, folder), "5 seconds")
    query = emit.on_close(live, "t", f"{folder}/out", trigger={"processingTime": "100 milliseconds"})
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    flat = emit.on_close(market.window_counts(_live(spark, f"{folder}/again"), "5 seconds"), "f", f"{folder}/flat")
    assert _same(spark.read.schema(flat.schema).parquet(f"{folder}/out/data"), flat)


def test_a_failing_stream_stops_the_others(spark, folder):
    t = _live(spark, folder)
    bad = t.select(F.raise_error(F.concat(F.lit("no "), "symbol")).cast("string").alias("x"))
    with pytest.raises(Exception):
        emit.on_close_all({"bad": bad, "counts": market.window_counts(t, "5 seconds")}, "m", f"{folder}/out")
    assert not spark.streams.active


def test_several_streams_go_on_by_trigger(spark, folder):
    plans = {"bars": lambda t: market.ohlc_full(t, "5 seconds", "ts"), "counts": lambda t: market.window_counts(t, "5 seconds")}
    live = _live(spark, folder)
    running = emit.on_close_all({n: p(live) for n, p in plans.items()}, "go", f"{folder}/out", {"processingTime": "100 milliseconds"})
    try:
        assert set(running) == set(plans) and all(q.isActive for q in running.values())
        for q in running.values():
            q.processAllAvailable()
        # Rows that come later are taken up by the same queries.
        spark.createDataFrame([("ZZZ", 1.0, 1, 20_000_000)], TRADES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for q in running.values():
            q.processAllAvailable()
    finally:
        for q in running.values():
            q.stop()
    for n, plan in plans.items():
        want = plan(_table(spark))
        got = spark.read.schema(want.schema).parquet(f"{folder}/out/{n}/data")
        assert _same(got, want)


def test_streams_that_cannot_start_leave_none_running(spark, folder):
    live = _live(spark, folder)
    bad = live.groupBy("symbol").count()
    with pytest.raises(Exception):
        emit.on_close_all({"counts": market.window_counts(live, "5 seconds"), "bad": bad}, "no", f"{folder}/out", {"processingTime": "100 milliseconds"})
    assert not spark.streams.active


# --- sources and sinks ----------------------------------------------------------------

def test_append_checks_schema_and_counts(spark, folder):
    rows = spark.createDataFrame(BATCHES[0], TRADES)
    path = f"{folder}/src"
    assert files.append(spark, rows, path, TRADES) == 30
    assert files.append(spark, rows.toArrow(), path, TRADES) == 30
    assert files.append(spark, rows.toPandas(), path, TRADES) == 30
    assert files.read_batch(spark, path, TRADES).count() == 90
    with pytest.raises(ValueError):
        files.append(spark, rows.drop("ts"), path, TRADES)
    holed = rows.select("symbol", F.lit(None).cast("double").alias("price"), "volume", "ts")
    with pytest.raises(Exception, match="null in NOT NULL column price"):
        files.append(spark, holed, path, TRADES)


def test_null_rows_are_routed(spark):
    df = spark.createDataFrame([("A", 1.0, 1, 1), ("B", None, 1, 1)],
                               "symbol string, price double, volume long, ts long")
    good, bad = files.split_valid(df, TRADES)
    assert (good.count(), bad.count()) == (1, 1)
    with pytest.raises(Exception, match="NOT NULL column price"):
        files.source(df, TRADES, on_null="fail").collect()


def test_bus_records_on_a_stream(spark, folder):
    sent = kafka_sink.encode_json(spark.createDataFrame(BATCHES[0], TRADES), "symbol")
    sent.selectExpr("CAST(key AS BINARY) key", "CAST(value AS BINARY) value").write.parquet(f"{folder}/in")
    live = kafka_source.decode_json(files.read_stream(spark, f"{folder}/in", KAFKA_RECORD))
    out = emit.on_close(live, "k", f"{folder}/out")
    assert sorted(map(tuple, out.drop("event_time").collect())) == sorted(BATCHES[0])


def test_bus_options():
    assert kafka_source.source_options("h:1", "t", "g", "earliest", 5) == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest",
        "kafka.group.id": "g", "maxOffsetsPerTrigger": "5"}
    assert kafka_sink.sink_options("h:1", "t") == {"kafka.bootstrap.servers": "h:1", "topic": "t"}


def test_jdbc_options():
    o = cdc_source.jdbc_options("h", 5432, "shop", "u", "p", "orders", "id", (1, 100), 8)
    assert o["url"] == "jdbc:postgresql://h:5432/shop" and o["numPartitions"] == "8"


def test_envelopes(spark):
    img = lambda i, c, a: f'{{"id":{i},"customer_id":{c},"amount":{a},"status":"x","ts":1}}'
    rows = [("orders", "I", 1, 1, None, img(1, 7, 10.0)), ("orders", "U", 2, 1, img(1, 7, 10.0), img(1, 7, 12.5)),
            ("orders", "D", 3, 1, img(1, 7, 12.5), None)]
    df = spark.createDataFrame(rows, "_table string, _op string, _lsn int, _ts_ms long, _before string, _after string")
    df = df.withColumn("_lsn", F.col("_lsn").cast(CDC_ENVELOPE["_lsn"].dataType))
    changes = cdc_source.decode_envelope(df)
    assert [r.amount for r in changes.orderBy("_lsn").collect()] == [10.0, 12.5, 12.5]
    assert [tuple(r) for r in cdc.customer_totals(changes).collect()] == [(7, 2, 22.5)]


def test_log_lines(spark):
    head = "table public.orders: "
    lines = [
        head + "INSERT: id[integer]:123 customer_id[integer]:5 amount[numeric]:299.50 "
               "status[character varying]:'on hold' ts[bigint]:99",
        head + "UPDATE: old-key: id[integer]:1 customer_id[integer]:8 new-tuple: id[integer]:1 "
               "customer_id[integer]:9 amount[numeric]:oops status[character varying]:'done' ts[bigint]:7",
        head + "UPDATE: id[integer]:2 customer_id[integer]:'3' amount[numeric]:1",
        head + "DELETE: id[integer]:2", head + "INSERT: id[integer]:4 customer_id[integer]:0",
        "table public.other: INSERT: id[integer]:4 customer_id[integer]:4", "COMMIT 7", None,
    ]
    df = spark.createDataFrame([(x,) for x in lines], LOG_LINE)
    assert [tuple(r) for r in cdc_source.decode_log_lines(df).collect()] == [
        (123, 5, 299.5, "on hold", 99), (1, 9, 0.0, "done", 7), (2, 3, 1.0, "", 0)]


def test_partitioned_table(spark, folder):
    df = spark.createDataFrame(BATCHES[0], TRADES)
    for i, files_per in enumerate([None, 2]):
        table_sink.write_table(df, f"{folder}/{i}", ["symbol"], files_per_partition=files_per)
        assert spark.read.parquet(f"{folder}/{i}").count() == 30
        assert len([d for d in os.listdir(f"{folder}/{i}") if d.startswith("symbol=")]) == 5


def test_source_metrics(spark):
    row = source_metrics(_table(spark, BATCHES[0]), "trades", "5 seconds").first()
    assert tuple(row) == ("trades", 30, T0, T0 + 29 * 400, T0 + 29 * 400 - 5_000)


def test_output_columns(spark):
    from tidemark.plans import fraud
    from tidemark.schemas import FRAUD_ORDERS, FRAUD_TRADES, OUTPUTS

    t, o = (with_event_time(spark.createDataFrame([], s)) for s in (FRAUD_TRADES, FRAUD_ORDERS))
    got = fraud.detection_streams(
        t, o.withColumn("order_no", F.lit(1)), hop_size="10 seconds", hop_slide="2 seconds",
        bar="5 seconds", burst_gap="2 seconds", wash="5 seconds", match="2 seconds", order="ts")
    extra = {"bar_start", "session_start", "session_end"}
    for name, df in got.items():
        want = OUTPUTS[name]
        assert [c for c in df.columns if c in want or c not in extra] == want, name
    plain = tumble_agg(t, ["symbol"], "5 seconds", M.ohlc("price", "ts"), start=None)
    assert plain.columns == OUTPUTS["ohlc"]


@pytest.mark.parametrize("name,cuts", [("stream_match", (1, 8, 40)), ("stream_asof", (1, 8)), ("stream_lag", (1, 8))])
def test_any_cut_into_micro_batches_gives_the_same(spark, data, monkeypatch, name, cuts):
    from tidemark.plans.registry import QUERIES
    from tidemark.sources import tables

    seen = []
    for batches in cuts:
        monkeypatch.setattr(tables, "_batches", batches)
        seen.append(sorted(map(tuple, QUERIES[name](spark, data).collect()), key=repr))
    assert all(s == seen[0] for s in seen) and len(seen[0]) > 300
