"""Totals with retraction and the snapshot cut-over, against plain replays of the log."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.sources import files
from tidemark.streaming import changes, emit
from test_streaming import _feed

LOG = T.StructType([
    T.StructField("k", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("_lsn", T.LongType()),
    T.StructField("g", T.StringType()), T.StructField("v", T.DoubleType()), T.StructField("n", T.LongType()),
])
TOTALS = {"rows": ("count", None), "sum_v": ("sum", "v"), "sum_n": ("sum", "n"), "low": ("min", "v"), "high": ("max", "n")}


def _log(n=400, keys=40):
    rng = random.Random(6)
    rows = [
        (rng.randrange(keys), rng.choice("IUUUD"), i, rng.choice(["hot", "hot", "hot", "x", None]),
         rng.choice([None, 0.1, 0.2, rng.randint(1, 30) / 10]), rng.choice([None, rng.randint(1, 9)]))
        for i in range(n)
    ]
    # Older changes that come again, and much later.
    return rows + rng.sample(rows, 30)


def _totals(rows):
    newest = {}
    for r in rows:
        if r[0] not in newest or newest[r[0]][2] < r[2]:
            newest[r[0]] = r
    out = {}
    for g in {r[3] for r in newest.values() if r[1] != "D"}:
        live = [r for r in newest.values() if r[1] != "D" and r[3] == g]
        v, n = [r[4] for r in live if r[4] is not None], [r[5] for r in live if r[5] is not None]
        out[g] = (len(live), round(sum(v), 6) if v else None, sum(n) if n else None, min(v, default=None), max(n, default=None))
    return out


def _stream(spark, folder, rows, cuts):
    size = -(-len(rows) // cuts)
    return files.read_stream(spark, _feed(spark, folder, [rows[k : k + size] for k in range(0, len(rows), size)], LOG), LOG, max_files=1)


def _as_dict(rows):
    return {r.g: (r.rows, r.sum_v and round(r.sum_v, 6), r.sum_n, r.low, r.high) for r in rows}


def _no_zero(totals):
    """A sum of nulls only is null in one form and 0 in the other once values have gone."""
    return {g: tuple(x or None for x in t) for g, t in totals.items()}


@pytest.mark.parametrize("cuts", [1, 8])
def test_totals_take_back_what_changes(spark, folder, cuts):
    rows = _log()
    log = changes.stream_current_totals(_stream(spark, folder, rows, cuts), ["k"], "_lsn", ["g"], TOTALS, salts=3)
    out = emit.on_update(log, "t", f"{folder}/out", mode="append")
    assert _no_zero(_as_dict(emit.apply_changes(out, ["g"]).collect())) == _no_zero(_totals(rows))
    # What -U and -D take back is what was told before, micro-batch by micro-batch.
    size, now = -(-len(rows) // cuts), {}
    for b in range(cuts):
        told = out.where(F.col("batch_id") == b).collect()
        for r in told:
            if r.change in ("-U", "-D"):
                assert now.pop(r.g) == tuple(r[c] for c in TOTALS)
        for r in told:
            if r.change in ("+I", "+U"):
                assert r.g not in now
                now[r.g] = tuple(r[c] for c in TOTALS)
        want = _totals(rows[: (b + 1) * size])
        assert {g: t[0] for g, t in now.items()} == {g: t[0] for g, t in want.items()}


def test_the_last_row_of_a_group_goes(spark, folder):
    rows = [(1, "I", 1, "a", 5.0, 1), (2, "I", 2, "a", 3.0, 2), (2, "U", 3, "b", 3.0, 2), (1, "D", 4, "a", 5.0, 1), (1, "U", 2, "a", 9.0, 9)]
    log = changes.stream_current_totals(_stream(spark, folder, rows, 5), ["k"], "_lsn", ["g"], TOTALS)
    out = emit.on_update(log, "t", f"{folder}/out", mode="append")
    assert sorted((r.batch_id, r.change, r.g, r.rows, r.low) for r in out.collect()) == [
        (0, "+I", "a", 1, 5.0), (1, "+U", "a", 2, 3.0), (1, "-U", "a", 1, 5.0),
        (2, "+I", "b", 1, 3.0), (2, "+U", "a", 1, 5.0), (2, "-U", "a", 2, 3.0), (3, "-D", "a", 1, 5.0)]


def test_a_hot_group_is_kept_in_parts(spark, folder):
    rows = [(k, "I", k, "hot", 1.0, 1) for k in range(300)]
    log = changes.stream_current_totals(_stream(spark, folder, rows, 1), ["k"], "_lsn", ["g"], {"rows": ("count", None)})
    query = emit.drain(spark, lambda: log.writeStream.outputMode("append").format("noop")
                       .option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start())
    groups, parts, images = (s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
    assert parts >= changes.SALTS - 2 and images >= 300


def test_keys_and_groups_differ(spark, folder):
    live = _stream(spark, folder, _log(40), 1)
    with pytest.raises(ValueError):
        changes.stream_current_totals(live, ["k"], "_lsn", ["k"], TOTALS)


@pytest.mark.parametrize("cuts", [1, 6])
def test_cut_over_counts_each_change_once(spark, folder, cuts):
    rng = random.Random(2)
    log = [(rng.randrange(20), rng.choice("IUD"), i, "g", float(i), i) for i in range(1, 200)]
    cut = 90
    newest = {r[0]: r for r in log if r[2] <= cut}
    snapshot = [(k, "I", cut, *r[3:]) for k, r in newest.items() if r[1] != "D"]
    around = [r for r in log if r[2] > 50]
    # Blocks of the log are delivered again after a lost acknowledgement.
    fed = [x for k in range(0, len(around), 30) for x in (*around[k : k + 30], *around[k : k + 30])] + [(5, "U", None, "g", 0.0, 0)]
    copy = f"{folder}/snapshot"
    spark.createDataFrame(snapshot + snapshot[:5], LOG).write.parquet(copy)
    once = changes.cut_over(spark.readStream.schema(LOG).parquet(copy), _stream(spark, folder, fed, cuts), ["k"], cut)
    assert once.columns == LOG.names
    out = emit.on_update(once, "t", f"{folder}/out", mode="append")
    assert sorted(tuple(r)[:6] for r in out.select(*LOG.names).collect()) == sorted(snapshot + [r for r in log if r[2] > cut])


def test_current_totals_hold_many_rows_a_call(spark, folder):
    """Rows of many keys, null among them, share a call; values of min and max are not asked for one by one."""
    rows = [(None if k == 0 else k % 50, "I", k, "g", float(k % 7), k) for k in range(200)]
    log = changes.stream_current_totals(_stream(spark, folder, rows, 2), ["k"], "_lsn", ["g"], TOTALS)
    query = emit.drain(spark, lambda: log.writeStream.outputMode("append").format("noop")
                       .option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start())
    _, parts, _ = (s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
    # A part has its totals and one list of values for min and one for max.
    assert parts <= 3 * changes.SALTS
    out = emit.on_update(log, "t", f"{folder}/out", mode="append")
    assert _as_dict(emit.apply_changes(out, ["g"]).collect()) == _totals(rows)
