"""Watermarks and the ways a continuous query hands out its results."""

from contextlib import contextmanager

from pyspark.sql import Window, functions as F

from ..functions.time import duration
from ..schemas import EVENT_TIME
from ..session import ROCKSDB, is_local, scratch
from ..sinks.foreach import for_each_batch, table_target
from ..sinks.tables import stream_to_table
from .bands import Matches


def watermark(df, delay, event_time=EVENT_TIME):
    """Rows older than the newest event time minus ``delay`` may be dropped as late."""
    return df.withWatermark(event_time, duration(delay))


@contextmanager
def stream_settings(spark):
    """Settings a query picks up when it starts.

    State lives in RocksDB, and a commit ships changes instead of whole snapshots;
    a join keeps both sides in one store a partition instead of four; several inputs
    advance with the slowest. Rows that hold chunks go to Python by bytes, not only by number. State partitions follow the session's shuffle partitions, except in a local
    session, where one per core is enough.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.multipleWatermarkPolicy": "min",
        "spark.sql.streaming.join.stateFormatVersion": "3",
        "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }
    if is_local(spark):
        wanted["spark.sql.shuffle.partitions"] = str(spark.sparkContext.defaultParallelism)
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(spark, start):
    """Start a query through ``start()`` and wait until its input is used up."""
    with stream_settings(spark):
        query = start()
        query.awaitTermination()
    return query


def _written(df):
    """The frame that is written for a result, and how its rows are read from there."""
    if isinstance(df, Matches):
        return df.found, df.unnested
    return df, lambda table: table


def on_close(df, name, folder=None, trigger=None, query=None):
    """Emit each window once, when the watermark passes its end; returns the result table.

    With a ``trigger`` (such as ``{"processingTime": "1 second"}``) the query goes on and
    its handle is returned; the results are in ``folder``/data. ``query`` names the running
    query for its progress; only one at a time may have a name. Nested matches are
    written as they are; the returned table has a row for each.
    """
    df, rows = _written(df)
    spark = df.sparkSession
    folder = folder or scratch(spark, name)
    start = lambda: stream_to_table(df, f"{folder}/data", f"{folder}/checkpoint", query, trigger=trigger)
    if trigger:
        with stream_settings(spark):
            return start()
    drain(spark, start)
    return rows(spark.read.schema(df.schema).parquet(f"{folder}/data"))


def on_close_all(streams, name, folder=None, trigger=None):
    """Several streams at once, each its own query and checkpoint; returns result tables by name.

    If one fails, the others are stopped. With a ``trigger`` (such as
    ``{"processingTime": "1 second"}``) the queries go on and their handles are returned by
    name; the results are in ``folder``/<name>/data.
    """
    rows = {n: _written(df)[1] for n, df in streams.items()}
    streams = {n: _written(df)[0] for n, df in streams.items()}
    spark = next(iter(streams.values())).sparkSession
    folder = folder or scratch(spark, name)
    running, done = {}, False
    with stream_settings(spark):
        try:
            for n, df in streams.items():
                running[n] = stream_to_table(df, f"{folder}/{n}/data", f"{folder}/{n}/checkpoint", trigger=trigger)
            if not trigger:
                for query in running.values():
                    query.awaitTermination()
            done = True
        finally:
            if not (done and trigger):
                for query in running.values():
                    query.stop()
    if trigger:
        return running
    return {n: rows[n](spark.read.schema(df.schema).parquet(f"{folder}/{n}/data")) for n, df in streams.items()}


def on_update(df, name, folder=None, complete=False, trigger=None, mode="update"):
    """Emit a row whenever a result changes; returns all emissions with their ``batch_id``.

    ``mode="append"`` is for chained states that hand out their changes themselves.

    With a ``trigger`` the query goes on and its handle is returned.
    """
    spark = df.sparkSession
    folder = folder or scratch(spark, name)
    mode = "complete" if complete else mode
    # So that a stream without rows has a table too.
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{folder}/data/batch_id=-1")
    start = lambda: for_each_batch(df, table_target(f"{folder}/data"), f"{folder}/checkpoint", mode, trigger)
    if trigger:
        with stream_settings(spark):
            return start()
    drain(spark, start)
    return spark.read.schema(df.schema.add("batch_id", "long")).parquet(f"{folder}/data")


def final_rows(updates, keys):
    """The last emission of each key."""
    rest = [c for c in updates.columns if c not in keys and c != "batch_id"]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def apply_changes(log, keys):
    """The rows a changelog leaves: the last ``+I`` or ``+U`` of each key that no ``-D`` follows."""
    now = final_rows(log.where("change <> '-U'"), list(keys))
    return now.where("change <> '-D'").drop("change")


def emit_changes(df, keys, totals, name, folder=None):
    """Changelog of running totals by key: ``+I``, then ``-U`` and ``+U``, for each micro-batch that changes a key.

    ``totals`` maps a result to ("count" | "sum" | "min" | "max", column). A key's
    last totals are its state; a micro-batch hands out the new ones, and the old ones
    are those that the key handed out before.
    """
    measure = {"count": lambda c: F.count(F.lit(1)), "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "min": F.min, "max": F.max}
    kind = lambda how, c: "long" if how == "count" else df.schema[c].dataType
    running = df.groupBy(*keys).agg(*[measure[how](c).cast(kind(how, c)).alias(n) for n, (how, c) in totals.items()])
    told = on_update(running, name, folder)
    now = F.struct(*totals)
    old = F.lag(now).over(Window.partitionBy(*keys).orderBy("batch_id"))
    step = lambda change, values: F.struct(F.lit(change).alias("change"), values.alias("v"))
    log = told.select(*keys, "batch_id", now.alias("_now"), old.alias("_old")).where("NOT (_now <=> _old)")
    first = F.array(step("+I", F.col("_now")))
    later = F.array(step("-U", F.col("_old")), step("+U", F.col("_now")))
    steps = log.select(*keys, "batch_id", F.explode(F.when(F.col("_old").isNull(), first).otherwise(later)).alias("_step"))
    return steps.select(*keys, "_step.change", *[F.col(f"_step.v.{n}").alias(n) for n in totals], "batch_id")


def keep_current(changes, keys, order, name, folder=None, op="_op", deleted=("D",)):
    """Current state of a change stream: newest row per key, deleted keys left out.

    A delete stays in the state, so an older change that arrives later does not
    bring its row back.
    """
    rest = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    now = final_rows(on_update(newest, name, folder), list(keys))
    return now.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest]).where(~F.col(op).isin(*deleted))


__all__ = [
    "apply_changes", "drain", "emit_changes", "final_rows", "keep_current", "on_close", "on_close_all", "on_update",
    "stream_settings", "watermark",
]
