"""Declared-schema file sources and batch ingest."""

from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F, types as T

from ..functions.time import with_event_time
from ..schemas import TIME


def _loose(schema):
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def read_stream(spark, path, schema, fmt="parquet", max_files=None, **options):
    """Streaming read with a declared schema; ``max_files`` limits one micro-batch."""
    reader = spark.readStream.schema(_loose(schema)).format(fmt).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_batch(spark, path, schema, fmt="parquet", **options):
    """Batch twin of ``read_stream`` over the same files."""
    return spark.read.schema(_loose(schema)).format(fmt).options(**options).load(path)


def _complete(schema):
    required = [f.name for f in schema.fields if not f.nullable]
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required], F.lit(True))


def split_valid(df, schema):
    """(rows that meet the NOT NULL columns, rows that do not).

    The test is a plain IS NOT NULL filter, so it reaches a parquet scan.
    """
    ok = _complete(schema)
    return df.where(ok), df.where(~ok)


def require(df, schema):
    """Fail the query on a null in a NOT NULL column."""
    for f in schema.fields:
        if not f.nullable:
            stop = F.raise_error(F.lit(f"null in NOT NULL column {f.name}")).cast(f.dataType)
            df = df.withColumn(f.name, F.coalesce(F.col(f.name), stop))
    return df


def source(df, schema, ts=TIME, on_null="reject"):
    """A checked source with its ``event_time`` column.

    ``on_null="reject"`` keeps the valid rows (take the others from
    ``split_valid``); ``on_null="fail"`` stops the query.
    """
    rows = require(df, schema) if on_null == "fail" else split_valid(df, schema)[0]
    return with_event_time(rows, ts)


def align(df, schema):
    """Declared columns in declared order and type; unknown or missing columns are an error."""
    have, want = set(df.columns), [f.name for f in schema.fields]
    if have != set(want):
        raise ValueError(
            f"columns differ from the declared schema: missing {sorted(set(want) - have)}, "
            f"unknown {sorted(have - set(want))}"
        )
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def append(spark, rows, path, schema, fmt="parquet"):
    """Append a batch to a source folder, where its stream picks it up; returns the row count.

    ``rows`` is a DataFrame, a pandas DataFrame or an Arrow table. The count is
    observed during the write, so the rows are read once.
    """
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows)
    seen = Observation()
    checked = require(align(df, schema), schema).observe(seen, F.count(F.lit(1)).alias("rows"))
    checked.write.mode("append").format(fmt).save(path)
    return seen.get["rows"]
