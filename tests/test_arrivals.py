"""Appends of a table in arrival order, however the table's own files are cut."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.plans.registry import QUERIES
from tidemark.sources import tables
from tidemark.streaming import emit


def _events(spark, folder, files):
    at = datetime(2024, 1, 1)
    rows = [(k, at + timedelta(minutes=k), k % 7, "view", 1.0, '{"k": 1}') for k in range(400)]
    df = spark.createDataFrame(rows, tables.TABLES["events"])
    df.repartitionByRange(files, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return rows


def test_an_append_is_one_micro_batch(spark, folder, monkeypatch):
    """A table of 13 files gives eight micro-batches, also when an append has several files."""
    rows = _events(spark, folder, 13)
    for file_rows in (1_000_000, 12):
        monkeypatch.setattr(tables, "FILE_ROWS", file_rows)
        tables._arrived.clear()
        seen = emit.on_update(tables.table(spark, folder, "events", stream=True), f"a{file_rows}", f"{folder}/{file_rows}", mode="append")
        got = sorted((r.event_id, r.batch_id) for r in seen.select("event_id", "batch_id").collect())
        assert got == [(r[0], r[0] * 8 // 400) for r in rows]


def test_appends_without_rows_are_micro_batches(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 40)
    at = datetime(2024, 1, 1)
    rows = [(k, at, 1, "view", 1.0, "{}") for k in (*range(100), *range(790, 800))] + [(None, at, 1, "view", 1.0, "{}")]
    spark.createDataFrame(rows, tables.TABLES["events"]).repartition(5).write.parquet(f"{folder}/events.parquet")
    seen = emit.on_update(tables.table(spark, folder, "events", stream=True), "e", f"{folder}/out", mode="append")
    assert {(r.event_id, r.batch_id) for r in seen.collect()} == {(None if r[0] is None else r[0], 0 if r[0] is None else r[0] // 100) for r in rows}


def test_changelog_of_a_table_of_many_files(spark, folder):
    """Every customer changes once in each micro-batch; more micro-batches would tell more changes."""
    rows = [(k, k % 3, "O", 1.0, datetime(2024, 1, 1), "x") for k in range(240)]
    spark.createDataFrame(rows, tables.TABLES["orders"]).repartition(12).write.parquet(f"{folder}/orders.parquet")
    log = QUERIES["stream_changes"](spark, folder).collect()
    assert len(log) == 3 * (1 + 7 * 2)
    assert sorted(r.total_orders for r in log if r.change != "-U") == sorted([10 * b for b in range(1, 9)] * 3)
