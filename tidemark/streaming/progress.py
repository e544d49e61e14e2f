"""Progress of running queries as a table: rows in, rows dropped late, rows out, for each micro-batch.

Spark counts the rows itself while a micro-batch runs: ``counted_in`` and ``counted_out``
put named counts at a source or a result, which come back with the micro-batch's progress. ``ProgressLog``
keeps every progress in a table in a shared folder.
"""

import json
import threading
import uuid

from pyspark.sql import functions as F, types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..schemas import TIME

PROGRESS = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("run", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("at", T.StringType()),
    T.StructField("rows_in", T.LongType()),
    T.StructField("rows_out", T.LongType()),
    T.StructField("rows_by_source", T.MapType(T.StringType(), T.LongType())),
    T.StructField("newest", T.LongType()),
    T.StructField("groups_dropped_late", T.LongType()),
    T.StructField("state_rows", T.LongType()),
    T.StructField("watermark", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
])
IN, OUT = "rows_in", "rows_out"
# Rows of one file; a full one is left alone from then on.
CHUNK = 1000


def counted_in(df, name="source", ts=TIME):
    """Count the rows a stream takes in, and its newest time, for each micro-batch.

    Several sources of one query need different names; their rows are added up.
    """
    return df.observe(f"{IN}:{name}", F.count(F.lit(1)).alias("rows"), F.max(ts).cast("long").alias("newest"))


def counted_out(df):
    """Count the rows a stream gives out, for each micro-batch."""
    return df.observe(OUT, F.count(F.lit(1)).alias("rows"))


def progress_row(p):
    """One row of ``PROGRESS`` from the JSON form of a progress; counts that weren't asked for are null.

    Without ``counted_in`` the rows of sources are those that Spark reports.
    """
    seen = p.get("observedMetrics") or {}
    ins = {n[len(IN) + 1:]: m for n, m in seen.items() if n.startswith(f"{IN}:")}
    newest = [m["newest"] for m in ins.values() if m.get("newest") is not None]
    state = p.get("stateOperators") or []
    # Spark counts a source once for every use of it in the plan; named counts are exact.
    taken = {n: m["rows"] for n, m in ins.items()} or {
        s.get("description"): int(s.get("numInputRows") or 0) for s in p.get("sources") or []}
    return (
        p.get("name"), p["runId"], int(p["batchId"]), p.get("timestamp"), sum(taken.values()),
        seen[OUT]["rows"] if OUT in seen else None, taken, max(newest, default=None),
        sum(int(s.get("numRowsDroppedByWatermark") or 0) for s in state),
        sum(int(s.get("numRowsTotal") or 0) for s in state),
        (p.get("eventTime") or {}).get("watermark"), int((p.get("durationMs") or {}).get("triggerExecution") or 0),
    )


class ProgressLog(StreamingQueryListener):
    """Writes the progress of all queries of a session to a table in a shared folder.

    The rows of a chunk are rewritten with each progress, in two places by turns, so that
    one whole copy stands at any time; so the table has at most two files for each
    ``CHUNK`` progresses, however long the queries run. A query's triggers without a
    micro-batch are left out.

    Use it as a context: it listens from the beginning to the end of the block. ``wait``
    returns when all progress of queries that have ended is written.
    """

    def __init__(self, spark, folder, chunk=CHUNK):
        self.spark, self.folder, self.chunk = spark, folder, chunk
        self._log, self._rows, self._number, self._turn = uuid.uuid4().hex, [], 0, 0
        self._ended, self._failed, self._change = 0, None, threading.Condition()
        # So that a log without progress is a table too.
        spark.createDataFrame([], PROGRESS).write.mode("overwrite").parquet(f"{folder}/log={self._log}/chunk=-1/copy=0")

    def __enter__(self):
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_):
        self.spark.streams.removeListener(self)

    def _write(self):
        place = f"{self.folder}/log={self._log}/chunk={self._number}/copy={self._turn}"
        self.spark.createDataFrame(self._rows, PROGRESS).coalesce(1).write.mode("overwrite").parquet(place)
        self._turn = 1 - self._turn
        if len(self._rows) >= self.chunk:
            self._rows, self._number, self._turn = [], self._number + 1, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = json.loads(event.progress.json)
        if not p.get("durationMs", {}).get("addBatch"):
            return
        self._rows.append(progress_row(p))
        try:
            self._write()
        except Exception as e:  # handed on by ``wait``; a listener must not end the query
            self._failed = e

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self._change:
            self._ended += 1
            self._change.notify_all()

    def wait(self, ended, seconds=60):
        """Wait until the ends of ``ended`` queries were seen, so that all their progress is in the table.

        A query's end comes after all its progress. A failed write is raised here.
        """
        with self._change:
            if not self._change.wait_for(lambda: self._ended >= ended, seconds):
                raise TimeoutError(f"{self._ended} of {ended} queries ended within {seconds} s")
        if self._failed:
            raise self._failed

    def table(self):
        return progress(self.spark, self.folder)


def progress(spark, folder):
    """The newest progress of every query's micro-batches, from all logs in the folder."""
    full = T.StructType(list(PROGRESS.fields)).add("log", "string").add("chunk", "long").add("copy", "integer")
    rows = spark.read.schema(full).parquet(folder).select(*PROGRESS.names)
    # A micro-batch that ran again after a restart counts once, as its last run has it.
    rest = [c for c in PROGRESS.names if c not in ("query", "batch_id")]
    last = rows.groupBy("query", "batch_id").agg(F.max_by(F.struct(*rest), "at").alias("_p"))
    return last.select("query", "batch_id", *[F.col(f"_p.{c}").alias(c) for c in rest])
