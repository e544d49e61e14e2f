"""Newest rows and throughput of a running stream; ``ranking.latest_by_key`` takes streams as it is (update mode).

Each task first trims its part of a micro-batch to what can still matter (``_trim``), so a
busy key sends at most ``n`` rows a task; the state of a key is its ``n`` newest rows. What
falls out is older than ``n`` rows that stay, so it can never come back, and results do not
depend on how rows fall into micro-batches. A place in the list is handed out again
whenever its row changes, ``emit.final_rows(updates, [*keys, rank])`` is the list as it is
now; lists never get shorter.
"""

import pandas as pd
from pyspark.sql import functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.time import align

# Rows travel as text, so that no value changes its type on the way through pandas.
_AS_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _places(df, order):
    """Columns that sort as ``order`` does, newest last: nulls first, NaN behind all numbers; none of them null."""
    out = []
    for i, c in enumerate(order):
        kind, v = df.schema[c].dataType, F.col(c)
        known = F.when(v.isNull(), 0).otherwise(1)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            known, value = F.when(F.isnan(v), 2).otherwise(known), F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0)).cast("double")
        elif isinstance(kind, T.StringType):
            value = F.coalesce(v, F.lit(""))
        elif isinstance(kind, T.DecimalType):
            value = F.coalesce(v, F.lit(0).cast(kind))
        elif isinstance(kind, (T.IntegralType, T.BooleanType)):
            value = F.coalesce(v.cast("long"), F.lit(0).cast("long"))
        elif isinstance(kind, T.TimestampType):
            value = F.coalesce(F.unix_micros(v), F.lit(0).cast("long"))
        elif isinstance(kind, T.DateType):
            value = F.coalesce(F.unix_date(v).cast("long"), F.lit(0).cast("long"))
        else:
            raise ValueError(f"rows can't be put in order by {c}: {kind.simpleString()}")
        out += [known.alias(f"known_{i}"), value.alias(f"place_{i}")]
    return out


def _newest(rows, n, by, merge):
    """The ``n`` newest rows of each key, newest first; with ``merge`` equal rows are one and their ``rows`` add up."""
    if merge:
        rows = rows.groupby(["key", *by], sort=False, as_index=False)["rows"].sum()
    rows = rows.sort_values(by, ascending=False, kind="stable")
    return rows.groupby("key", sort=False).head(n)


def _trim(n, by, merge, names):
    def part(batches):
        kept = None
        for pdf in batches:
            kept = _newest(pdf if kept is None else pd.concat([kept, pdf], ignore_index=True), n, by, merge)
        if kept is not None and len(kept):
            yield kept[names]
    return part


class Newest(StatefulProcessor):
    """State of a key: its ``n`` newest rows. Hands out the places whose row has changed."""

    def __init__(self, n, by, merge, state):
        self.n, self.by, self.merge, self.state = n, by, merge, state

    def init(self, handle):
        self.rows = handle.getListState("newest", self.state)

    def handleInputRows(self, key, rows, timerValues):
        old = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        known = pd.DataFrame(old, columns=self.state.names).assign(key=key[0])
        # What is known stands first, so of equal rows it keeps its place.
        every = [known] if old else []
        every += [pdf[["key", *self.state.names]] for pdf in rows]
        now = _newest(pd.concat(every, ignore_index=True), self.n, self.by, self.merge)
        now = [tuple(x.item() if hasattr(x, "item") else x for x in r)
               for r in now[self.state.names].itertuples(index=False, name=None)]
        if now == old:
            return
        self.rows.put(now)
        at = self.state.names.index("body")
        told = [(key[0], i + 1, r[at], r[-1]) for i, r in enumerate(now) if i >= len(old) or r != old[i]]
        yield pd.DataFrame(told, columns=["key", "rank", "body", "rows"])

    def close(self):
        pass


def _step(df, n, keys, order, body, merge):
    """(key, rank, body, rows) of every place that changes; key and body as text."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    text = lambda cols: F.to_json(F.struct(*cols), _AS_TEXT) if cols else F.lit("{}")
    flat = df.select(
        text(keys).alias("key"), *_places(df, order), text(body).alias("body"),
        (F.col("_rows") if merge else F.lit(1)).cast("long").alias("rows"),
    )
    state = T.StructType([T.StructField(f.name, f.dataType, True) for f in flat.schema.fields[1:]])
    # Rows of equal order go by their text, so that the result is defined.
    by = state.names[:-1]
    trimmed = flat.mapInPandas(_trim(n, by, merge, flat.columns), flat.schema)
    out = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("rank", T.IntegerType()),
        T.StructField("body", T.StringType()), T.StructField("rows", T.LongType()),
    ])
    return trimmed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Newest(n, by, merge, state), outputStructType=out, outputMode="append", timeMode="None",
    )


def _back(df, column, names):
    schema = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in names])
    return F.from_json(column, schema, _AS_TEXT)


def stream_recent(df, n, order, keys=(), rank="rank"):
    """The ``n`` newest rows of a stream, over all rows or per key: a row for each place that changes.

    ``order`` names columns, newest last, nulls before all else; rows that tie go by their
    text as JSON, and repeated rows each take a place. Needs append mode,
    ``emit.on_update(..., mode="append")``. Without keys all trimmed rows meet in one task,
    at most ``n`` for each task before it.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if rank in df.columns:
        raise ValueError(f"the stream has a column {rank}; give another name for the place")
    told = _step(df, n, keys, list(order), rest, merge=False)
    heads = [_back(df, "key", keys).alias("k")] if keys else []
    return told.select(*heads, F.col("rank").alias(rank), _back(df, "body", rest).alias("b")).select(
        *[F.col("k")[c].alias(c) for c in keys], rank, *[F.col("b")[c].alias(c) for c in rest])


def stream_throughput(df, keys=(), size_ms=1000, ts="ts", name="rows", last=60, rank="rank"):
    """Rows per tick and key, of the ``last`` newest ticks that hold rows: a row for each place that changes."""
    keys = list(keys)
    ticks = df.select(*keys, align(ts, size_ms).alias("tick"), F.lit(1).alias("_rows"))
    told = _step(ticks, last, keys, ["tick"], ["tick"], merge=True)
    heads = [_back(ticks, "key", keys).alias("k")] if keys else []
    return told.select(*heads, F.col("rank").alias(rank), _back(ticks, "body", ["tick"])["tick"].alias("tick"), F.col("rows").alias(name)).select(
        *[F.col("k")[c].alias(c) for c in keys], rank, "tick", name)


__all__ = ["stream_recent", "stream_throughput"]
