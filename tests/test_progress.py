"""Progress of running queries as a table."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions.time import with_event_time
from tidemark.plans import market
from tidemark.schemas import TRADES
from tidemark.sources import files
from tidemark.streaming import emit, progress

BATCHES = [
    [("A", 1.0, 1, 1_000_000), ("B", 2.0, 1, 1_001_000)],
    [("A", 3.0, 1, 1_020_000)],
    [("B", 4.0, 1, 1_040_000), ("B", 4.0, 1, 1_041_000), ("A", 5.0, 1, 1_042_000)],
]


def _append(spark, path, rows):
    spark.createDataFrame(rows, TRADES).coalesce(1).write.mode("append").parquet(path)


def _live(spark, path, name="source"):
    rows = with_event_time(files.read_stream(spark, path, TRADES, max_files=1))
    return emit.watermark(progress.counted_in(rows, name), "1 second")


def _counts(spark, path, folder, query="counts"):
    counts = market.window_counts(_live(spark, path), "10 seconds")
    return emit.on_close(progress.counted_out(counts), query, folder, query=query)


def _files(folder):
    return [f for _, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def test_rows_in_and_out_sum_to_the_tables(spark, folder):
    for rows in BATCHES:
        _append(spark, f"{folder}/in", rows)
    with progress.ProgressLog(spark, f"{folder}/log") as log:
        out = _counts(spark, f"{folder}/in", f"{folder}/out")
        log.wait(1)
        seen = {r.batch_id: r for r in log.table().collect()}
    total = sum(len(b) for b in BATCHES)
    assert {r.query for r in seen.values()} == {"counts"}
    assert sum(r.rows_in for r in seen.values()) == total
    assert sum(r.rows_out or 0 for r in seen.values()) == out.count() == 3
    assert sorted(r.rows_in for r in seen.values() if r.rows_in) == [1, 2, 3]
    assert max(r.newest for r in seen.values() if r.newest is not None) == 1_042_000
    assert all(r.groups_dropped_late == 0 for r in seen.values())


def test_log_goes_on_after_a_restart_and_counts_nothing_twice(spark, folder):
    for i, rows in enumerate(BATCHES):
        _append(spark, f"{folder}/in", rows)
        # A new log each time, as after a restart of the driver, in the same folder.
        with progress.ProgressLog(spark, f"{folder}/log") as log:
            _counts(spark, f"{folder}/in", f"{folder}/out")
            log.wait(1)
        done = log.table().agg(F.sum("rows_in"), F.count(F.lit(1)), F.count_distinct("batch_id")).first()
        assert done[0] == sum(len(b) for b in BATCHES[: i + 1])
        assert done[1] == done[2]


def _event(batch, at, rows=5, run="r", query="q"):
    return progress.progress_row({
        "name": query, "runId": run, "batchId": batch, "timestamp": at, "durationMs": {"addBatch": 1, "triggerExecution": 7},
        "observedMetrics": {"rows_in:left": {"rows": rows, "newest": 10}, "rows_in:right": {"rows": 1, "newest": None}, "rows_out": {"rows": 2}},
        "stateOperators": [{"numRowsDroppedByWatermark": 3, "numRowsTotal": 4}, {"numRowsTotal": 6}],
        "eventTime": {"watermark": "1970-01-01T00:00:09.000Z"}, "sources": [{"description": "d", "numInputRows": 99}],
    })


def test_row_of_a_progress():
    row = dict(zip(progress.PROGRESS.names, _event(4, "t")))
    assert row["rows_in"] == 6 and row["rows_by_source"] == {"left": 5, "right": 1} and row["rows_out"] == 2
    assert row["newest"] == 10 and row["groups_dropped_late"] == 3 and row["state_rows"] == 10 and row["duration_ms"] == 7
    # Nothing was asked for: Spark's own count of the source, no count of the result.
    bare = dict(zip(progress.PROGRESS.names, progress.progress_row({
        "runId": "r", "batchId": 0, "sources": [{"description": "d", "numInputRows": 9}]})))
    assert bare["rows_in"] == 9 and bare["rows_by_source"] == {"d": 9} and bare["rows_out"] is None and bare["query"] is None


def test_files_of_the_log_are_bounded(spark, folder):
    log = progress.ProgressLog(spark, f"{folder}/log", chunk=4)
    empty = len(_files(f"{folder}/log"))
    for b in range(10):
        log._rows.append(_event(b, f"2020-01-01T00:00:{b:02d}"))
        log._write()
    # Two places for each of three chunks, however often they are written.
    assert len(_files(f"{folder}/log")) - empty <= 6
    assert sorted(r.batch_id for r in log.table().collect()) == list(range(10))
    # A micro-batch that ran again counts as its last run has it.
    log._rows.append(_event(9, "2020-01-02T00:00:00", rows=7, run="again"))
    log._write()
    assert log.table().where("batch_id = 9").first().rows_in == 8
    assert log.table().count() == 10


def test_empty_log_is_a_table_and_a_missing_end_is_told(spark, folder):
    with progress.ProgressLog(spark, f"{folder}/log") as log:
        assert log.table().count() == 0
        with pytest.raises(TimeoutError):
            log.wait(1, seconds=0.1)
