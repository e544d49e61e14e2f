"""Change-log sources: envelopes with before and after images, and decoded text lines."""

from pyspark.sql import functions as F, types as T

from ..functions.json_codec import parsed_once
from ..schemas import CDC_ORDERS


def decode_envelope(envelopes, schema=CDC_ORDERS):
    """Row image of each change with its ``_table, _op, _lsn, _ts_ms`` columns.

    Inserts and updates carry the after image, deletes the before image.
    """
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    image = F.when(F.col("_op") == "D", F.col("_before")).otherwise(F.col("_after"))
    own = ["_table", "_op", "_lsn", "_ts_ms"]
    return parsed_once(envelopes, F.from_json(image, loose), "_row", own).select(*own, "_row.*")


def jdbc_options(host, port, database, username, password, table, partition_column=None,
                 bounds=None, partitions=None, fetch_size=10_000):
    """Options for the snapshot read of an upstream table, split over tasks by a numeric column."""
    opts = {
        "url": f"jdbc:postgresql://{host}:{port}/{database}",
        "dbtable": table,
        "user": username,
        "password": password,
        "fetchsize": str(fetch_size),
    }
    if partition_column:
        lo, hi = bounds
        opts.update(
            partitionColumn=partition_column, lowerBound=str(lo), upperBound=str(hi),
            numPartitions=str(partitions),
        )
    return opts


def read_snapshot(spark, **connection):
    """Snapshot side of a change log; needs the JDBC driver jar at submit time."""
    return spark.read.format("jdbc").options(**jdbc_options(**connection)).load()


def snapshot_as_changes(rows, table, lsn=0):
    """A snapshot as insert changes, to be united with decoded envelopes."""
    return rows.select(
        F.lit(table).alias("_table"), F.lit("I").alias("_op"),
        F.lit(lsn).cast("decimal(20,0)").alias("_lsn"),
        F.unix_millis(F.current_timestamp()).alias("_ts_ms"), *rows.columns,
    )


# fixed values: markers of the textual change log
TABLE_MARK = "table public.orders:"
INSERT_MARK, UPDATE_MARK, NEW_MARK = "INSERT:", "UPDATE:", "new-tuple:"


def decode_log_lines(lines, value="value", schema=CDC_ORDERS):
    """Order rows from textual change-log lines ``table t: OP: col[type]:value ...``.

    Only inserts and updates of the orders table count; an update uses its new
    image. A missing or malformed number becomes 0, and rows without a customer
    are left out.
    """
    text = F.col(value)
    insert = text.contains(INSERT_MARK)
    update = text.contains(UPDATE_MARK)
    new_image = update & ~insert & text.contains(NEW_MARK)
    cells = F.when(new_image, F.substring_index(text, NEW_MARK, -1)).otherwise(text)
    rows = lines.where(text.contains(TABLE_MARK) & (insert | update)).select(cells.alias("_cells"))
    found = lambda group: F.regexp_extract_all("_cells", F.lit(_CELL), F.lit(group))
    # A generator, so that the line is read once and not once a field.
    read = rows.select(F.explode(F.array(F.struct(found(1).alias("names"), found(2).alias("values")))).alias("_line"))
    out = read.select(*[_cell(f.name, f.dataType).alias(f.name) for f in schema.fields])
    return out.where(F.col("customer_id") != 0)


# A quoted value may hold blanks; a bare one ends at the next blank.
_CELL = r"\s(\w+)\[[^\]]*\]:'?((?<=')[^']*|[^'\s]*)"


def _cell(name, dtype):
    at = F.array_position("_line.names", name).cast("int") - 1
    raw = F.coalesce(F.get("_line.values", at), F.lit(""))
    if isinstance(dtype, T.StringType):
        return raw
    return F.coalesce(raw.try_cast(dtype), F.lit(0).cast(dtype))
