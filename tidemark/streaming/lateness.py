"""Late rows of a running stream, kept aside and counted before anything is aggregated.

A row is late if its time is more than ``delay`` behind the newest time that arrived
before it, whichever micro-batch brought that: inside a micro-batch rows are compared in
arrival order, and the newest time of all earlier ones is carried along. So the split
does not depend on how rows fall into micro-batches.

``<folder>/rows`` holds every row once, by micro-batch and ``is_late``; ``<folder>/marks``
one row for each micro-batch: its counts and the newest time so far. A micro-batch that
runs again replaces both.
"""

from pyspark.sql import Observation, functions as F, types as T

from ..operators.late import mark_late
from ..session import scratch
from ..sinks.foreach import for_each_batch, kept
from .emit import drain, stream_settings

MARKS = T.StructType([
    T.StructField("rows_in", T.LongType()), T.StructField("rows_late", T.LongType()),
    T.StructField("high_water", T.LongType()), T.StructField("batch_id", T.LongType()),
])


def _part(folder, arrival, segments, delay, ts):
    last = {}

    def each(batch, batch_id):
        spark = batch.sparkSession
        if last.get("batch") == batch_id - 1:
            before = last["newest"]
        else:
            before = marks(spark, folder).where(F.col("batch_id") < batch_id).agg(F.max("high_water")).first()[0]
        seen = Observation()
        with kept(batch):
            marked = mark_late(batch, arrival, segments, delay, ts, since=before).observe(
                seen, F.count(F.lit(1)).alias("rows"), F.count_if("is_late").alias("late"), F.max(ts).alias("newest")
            )
            marked.write.mode("overwrite").partitionBy("is_late").parquet(f"{folder}/rows/batch_id={batch_id}")
        got = seen.get
        newest = max((x for x in (before, got["newest"]) if x is not None), default=None)
        mark = [F.lit(x).cast("long").alias(n) for n, x in zip(MARKS.names, (got["rows"], got["late"], newest))]
        spark.range(1).select(*mark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch_id={batch_id}")
        last.update(batch=batch_id, newest=newest)
    return each


def split_stream(df, arrival, segments, delay, name, folder=None, ts="ts", trigger=None, query=None):
    """Part a stream into on-time and late rows; returns the folder, or with a ``trigger`` the running query.

    ``arrival`` and ``segments`` as in ``mark_late``. Rows without a time are on time.
    ``query`` names the running query for its progress.
    """
    spark = df.sparkSession
    folder = folder or scratch(spark, name)
    # So that a stream without rows has its tables too.
    spark.createDataFrame([], MARKS).drop("batch_id").write.mode("overwrite").parquet(f"{folder}/marks/batch_id=-1")
    empty = df.sparkSession.createDataFrame([], df.schema).withColumn("watermark", F.lit(None).cast("long"))
    empty.write.mode("overwrite").parquet(f"{folder}/rows/batch_id=-1/is_late=false")
    start = lambda: for_each_batch(df, _part(folder, arrival, segments, delay, ts), f"{folder}/checkpoint", trigger=trigger, name=query)
    if trigger:
        with stream_settings(spark):
            return start()
    drain(spark, start)
    return folder


def marks(spark, folder):
    """Rows in, late rows and newest time so far, for each micro-batch."""
    return spark.read.schema(MARKS).parquet(f"{folder}/marks").where("batch_id >= 0")


def parted(spark, folder, schema):
    """All rows of the stream with ``watermark`` (ms), ``batch_id`` and ``is_late``."""
    full = T.StructType(list(schema.fields)).add("watermark", "long").add("batch_id", "long").add("is_late", "boolean")
    return spark.read.schema(full).parquet(f"{folder}/rows")


def on_time_stream(spark, folder, schema, max_files=None):
    """The on-time rows as a stream of their own, for windows and joins behind the split."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{folder}/rows/batch_id=*/is_late=false")
