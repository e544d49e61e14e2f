"""The given tables as trades, quotes, orders and change logs."""

from decimal import Decimal

from pyspark.sql import functions as F, types as T

from ..functions import json_codec
from ..functions.time import with_event_time
from ..session import scratch
from .files import append, read_batch, read_stream

_L, _I, _S, _D, _TS = (
    T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampType()
)


def _schema(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Timestamps are declared as instants, so no session time zone takes part.
TABLES = {
    "events": _schema(
        ("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S), ("value", _D),
        ("props", _S),
    ),
    "orders": _schema(
        ("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
        ("o_orderdate", _TS), ("o_orderpriority", _S),
    ),
    "customer": _schema(
        ("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D),
        ("c_mktsegment", _S),
    ),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
}


# The order in which a table's rows arrive on its stream, and in how many appends.
ARRIVAL = {"events": "event_id", "orders": "o_orderkey"}
_batches = 8
_arrived = {}
# Rows of a file of an append, about.
FILE_ROWS = 100_000


def arrivals(spark, folder, name, batches=None, order=None):
    """A folder with all rows of a table in ``batches`` appends, in arrival order; written once a session.

    ``order`` is an integer SQL expression; append number b holds the b-th equal
    part of its range. Rows for which it is null come first. Returns the folder and
    how many files each append has, the same for all of them: so many are a micro-batch,
    however the table's own files are cut.
    """
    order, batches = order or ARRIVAL[name], batches or _batches
    key = (spark.sparkContext.applicationId, folder, name, batches, order)
    if key not in _arrived:
        rows, place = table(spark, folder, name), F.expr(order)
        lo, hi = rows.agg(F.min(place), F.max(place)).first()
        path = scratch(spark, f"arrivals-{name}")
        parts = []
        for b in range(batches):
            part = place.isNull() if b == 0 else F.lit(False)
            if lo is not None:
                part = part | ((place >= lo + -(-b * (hi - lo + 1) // batches)) & (place < lo + -(-(b + 1) * (hi - lo + 1) // batches)))
            parts.append(part)
        most = max(rows.agg(*[F.count_if(p) for p in parts]).first())
        each = max(1, -(-most // FILE_ROWS))
        for b, part in enumerate(parts):
            append(spark, rows.where(part).repartition(each), path, TABLES[name])
            # Tasks without rows write no file.
            for _ in range((b + 1) * each - len(read_batch(spark, path, TABLES[name]).inputFiles())):
                append(spark, rows.where(F.lit(False)).coalesce(1), path, TABLES[name])
        _arrived[key] = path, each
    return _arrived[key]


def table(spark, folder, name, stream=False, **arrival):
    """A table that is one parquet file or a folder of them; its stream takes an append at a time."""
    if stream:
        path, files = arrivals(spark, folder, name, **arrival)
        return read_stream(spark, path, TABLES[name], max_files=files)
    return read_batch(spark, f"{folder}/{name}.parquet", TABLES[name])


# Room for any 64-bit id behind the microseconds, so that order values never tie.
_ID_ROOM = Decimal(10**19)


def trades(spark, folder, stream=False, **arrival):
    """Every event as a trade. ``seq`` orders by event time and id, as one number."""
    return with_event_time(
        table(spark, folder, "events", stream, **arrival).select(
            "event_id",
            F.concat(F.lit("ACCT-"), F.col("user_id").cast("string")).alias("account_id"),
            F.col("event_type").alias("symbol"),
            F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
            F.col("value").alias("price"),
            json_codec.field("props", "$.k", "long").alias("volume"),
            F.concat(F.lit("ORD-"), F.col("event_id").cast("string")).alias("order_ref"),
            F.unix_millis("ts").alias("ts"),
            (F.unix_micros("ts").cast("decimal(18,0)") * F.lit(_ID_ROOM) + F.col("event_id")).cast("decimal(38,0)").alias("seq"),
        )
    )


# A quote or order is dated before its trade by the trade's volume times this.
QUOTE_LEAD_MS = 10_000
ORDER_LEAD_MS = 20_000
HALF_SPREAD = 0.0005


def quotes(spark, folder, stream=False, **arrival):
    """Every event as a quote around its value, dated up to 17 minutes before the trade."""
    t = trades(spark, folder, stream, **arrival)
    return with_event_time(t.select(
        F.col("event_id").alias("quote_id"), "symbol",
        (F.col("price") * F.lit(1 - HALF_SPREAD)).alias("bid"),
        (F.col("price") * F.lit(1 + HALF_SPREAD)).alias("ask"),
        (F.col("ts") - F.col("volume") * QUOTE_LEAD_MS).alias("ts"),
    ))


def orders(spark, folder, stream=False, **arrival):
    """Every event as an order, dated up to 33 minutes before the trade."""
    t = trades(spark, folder, stream, **arrival)
    return with_event_time(t.select(
        F.col("event_id").alias("order_no"), F.col("order_ref").alias("order_id"),
        "account_id", "symbol", "side", F.col("volume").alias("quantity"), "price",
        (F.col("ts") - F.col("volume") * ORDER_LEAD_MS).alias("ts"),
    ))


def order_envelopes(spark, folder, stream=False, **arrival):
    """The orders table as a change log: open rows insert, filled update, pending delete."""
    o = table(spark, folder, "orders", stream, **arrival)
    image = F.to_json(F.struct(
        F.col("o_orderkey").cast("int").alias("id"),
        F.col("o_custkey").cast("int").alias("customer_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("status"),
        F.unix_millis("o_orderdate").alias("ts"),
    ))
    op = F.when(F.col("o_orderstatus") == "O", "I").when(F.col("o_orderstatus") == "F", "U").otherwise("D")
    return o.select(
        F.lit("orders").alias("_table"), op.alias("_op"),
        F.col("o_orderkey").cast("decimal(20,0)").alias("_lsn"),
        F.unix_millis("o_orderdate").alias("_ts_ms"),
        F.when(op != "I", image).alias("_before"),
        F.when(op != "D", image).alias("_after"),
    )


def order_log_lines(spark, folder, stream=False):
    """The orders table as textual change-log lines."""
    o = table(spark, folder, "orders", stream)
    status = F.col("o_orderstatus")
    text = lambda c: F.col(c).cast("string")
    cells = F.concat(
        F.lit("id[integer]:"), text("o_orderkey"),
        F.lit(" customer_id[integer]:"), text("o_custkey"),
        F.lit(" amount[numeric]:"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.lit(" status[character varying]:'"), F.col("o_orderpriority"),
        F.lit("' ts[bigint]:"), F.unix_millis("o_orderdate").cast("string"),
    )
    head = F.when(status == "O", " INSERT: ").when(
        status == "F", " UPDATE: old-key: id[integer]:0 new-tuple: "
    ).otherwise(" DELETE: ")
    return o.select(F.concat(F.lit("table public.orders:"), head, cells).alias("value"))
