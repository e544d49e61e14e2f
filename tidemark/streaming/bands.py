"""Band joins of two watermarked streams, by chunks instead of rows.

Spark's stream join looks at one pair of rows after the other, in its state. Here the rows of a
micro-batch that share the keys and a time bucket go as one chunk, sorted by time, into that
join: its state and its pairs are chunks. Of a pair of chunks, the matches of a left row are one
range of the right rows, found by binary search. So the state's work grows with the rows; only
``unnested`` makes the pairs of rows, and they grow with the square of the rows in a band.

A chunk stands in the join with an event time, by which Spark drops it from the state or as late:
the end of the bucket for left rows, and for right rows their newest time, or if that is older
the first time that the end of the bucket matches. Two chunks of a bucket then always lie in the
band, so states and the watermark behind the join are those of single rows. A late row stays if
its chunk isn't late.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.time import align, interval_lit
from . import packs

# Rows of a chunk at most, so that a busy bucket is many pairs of chunks.
ROWS = 4_096
# Rows that a task sorts at a time, and that it hands over at a time.
SORTED, HANDED = 200_000, 20_000


class Matches:
    """Matches of a band join, nested: ``l`` holds left rows with the place and number of theirs in ``r``, from ``found``."""

    def __init__(self, found, select, where):
        self.found, self.select, self.where = found, select, where

    def unnested(self, found=None):
        """One row a match; ``found`` is the table that the nested ones were written to."""
        out = (self.found if found is None else found).select(F.explode("l").alias("l"), "r").select(
            "l", F.explode(F.slice("r", F.col("l._first") + 1, F.col("l._n"))).alias("r"))
        return (out if self.where is None else out.where(self.where)).selectExpr(*self.select)


def _used(df, side, texts, *more):
    """The fields of a side that the expressions name."""
    names = {*more, *(c for x in texts if x for c in re.findall(rf"\b{side}\.`?(\w+)", x))}
    return [f for f in df.schema.fields if f.name in names]


def _table(batches):
    return pa.Table.from_batches(batches).combine_chunks()


def _column(table, name):
    """A column as one array."""
    c = table[name]
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _chunks(df, on, fields, order, stands, event_time):
    """Rows of a micro-batch with ``on`` and ``_bucket`` as chunks ``rows`` sorted by ``order``; ``stands`` gives their event times."""
    own, when = [T.StructField(k, df.schema[k].dataType, True) for k in on], df.schema[event_time]
    schema = T.StructType([
        *own, T.StructField("_bucket", T.LongType(), True), T.StructField(event_time, T.TimestampType(), True, when.metadata),
        T.StructField("rows", T.ArrayType(T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])), True)])
    arrow, by, names = to_arrow_schema(schema), [*on, "_bucket"], [f.name for f in fields]

    def chunked(batches):
        table = _table(batches)
        coded = pa.table({"_code": packs.codes(table, by), **{c: table[c] for c in order}})
        keys = [("_code", "ascending"), *[(c, "ascending") for c in order]]
        place = pc.sort_indices(coded, sort_keys=keys, null_placement="at_start")
        table, code = table.take(place).combine_chunks(), coded["_code"].to_numpy()[place.to_numpy()]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        # A long run of a bucket is cut.
        first = np.concatenate([np.arange(a, b, ROWS) for a, b in zip(first, [*first[1:], len(code)])])
        last = np.append(first[1:], len(code))
        heads = table.select(by).take(pa.array(first))
        at = stands(_column(heads, "_bucket").to_numpy(), _column(table, order[0]).to_numpy()[last - 1])
        values = pa.StructArray.from_arrays([_column(table, n).cast(t.type) for n, t in zip(names, arrow.field("rows").type.value_type)], fields=list(arrow.field("rows").type.value_type))
        rows = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), values, type=arrow.field("rows").type)
        parts = [_column(heads, k) for k in by] + [pa.array(at * 1_000).cast(arrow.field(event_time).type), rows]
        whole = pa.Table.from_arrays([a.cast(f.type) for a, f in zip(parts, arrow)], schema=arrow)
        yield from whole.to_batches(max(1, HANDED // int((last - first).max())))

    def chunk(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= SORTED:
                yield from chunked(held)
                held, n = [], 0
        if held:
            yield from chunked(held)

    needed = list(dict.fromkeys([*by, *names, *order]))
    return df.select(*needed, event_time).repartition(*by).select(*needed).mapInArrow(chunk, schema)


def _ranges(batch, lo, hi, width, ts):
    """Left and right rows of a batch of pairs of chunks; row numbers of the left rows; the first match of each, and the end."""
    l, r = (_flat(batch.column(batch.schema.get_field_index(c))) for c in ("l", "r"))
    bucket = batch.column(batch.schema.get_field_index("_bucket")).to_numpy()
    room = width + hi - lo + 1
    place = lambda rows, by: np.repeat(np.arange(len(bucket)) * room - bucket, rows) + by
    lt, rt = (x[0].field(ts).to_numpy() for x in (l, r))
    there = place(r[1], rt - lo)
    return l, r, np.searchsorted(there, place(l[1], lt), "left"), np.searchsorted(there, place(l[1], lt + hi - lo), "right")


def _flat(lists):
    """Values of a list column and how many each row has."""
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


def _joined(left, right, on, lo, hi, width, texts, ts, event_time, order):
    """Pairs of chunks of a bucket, as ``l`` and ``r``."""
    lf, rf = _used(left, "l", texts, ts), _used(right, "r", texts, ts, *order)
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*on, ts])
    l = left.where(known).withColumn("_bucket", align(ts, width))
    first, last = align(F.col(ts) - F.lit(hi), width), align(F.col(ts) - F.lit(lo), width)
    r = right.where(known).withColumn("_bucket", F.explode(F.sequence(first, last, F.lit(width).cast("long"))))
    end = lambda bucket: bucket + (width - 1)
    l = _chunks(l, on, lf, [ts], lambda bucket, newest: end(bucket), event_time).alias("l")
    r = _chunks(r, on, rf, [ts, *order], lambda bucket, newest: np.maximum(newest, end(bucket) + lo), event_time).alias("r")
    lt, rt = F.col(f"l.{event_time}"), F.col(f"r.{event_time}")
    cond = (F.col("l._bucket") == F.col("r._bucket")) & (rt >= lt + interval_lit(lo)) & (rt <= lt + interval_lit(hi))
    for k in on:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    pairs = l.join(r, cond)
    return pairs.select("l._bucket", F.col("l.rows").alias("l"), F.col("r.rows").alias("r"))


def band_matches(left, right, on, lo, hi, width, select, ts, event_time, where=None):
    """``joins.band_join`` of two streams, nested; times in milliseconds."""
    pairs = _joined(left, right, list(on), lo, hi, width, [*select, where], ts, event_time, [])
    number = T.IntegerType()
    fields = [*pairs.schema["l"].dataType.elementType, T.StructField("_first", number, True), T.StructField("_n", number, True)]
    schema = T.StructType([T.StructField("l", T.ArrayType(T.StructType(fields)), True), T.StructField("r", pairs.schema["r"].dataType, True)])
    arrow = to_arrow_schema(schema)

    def match(batches):
        for batch in batches:
            (l, many), (_, held), first, end = _ranges(batch, lo, hi, width, ts)
            row, n = np.repeat(np.arange(len(many)), many), end - first
            hit = np.flatnonzero(n)
            if len(hit):
                first, n, row = first[hit] - (np.cumsum(held) - held)[row[hit]], n[hit], row[hit]
                kind = arrow.field("l").type
                l = l.take(pa.array(hit))
                values = pa.StructArray.from_arrays([*l.flatten(), pa.array(first, pa.int32()), pa.array(n, pa.int32())], fields=list(kind.value_type))
                kept, start = np.unique(row, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), values, type=kind)
                r = batch.column(batch.schema.get_field_index("r")).take(pa.array(kept)).cast(arrow.field("r").type)
                yield from pa.Table.from_arrays([lists, r], schema=arrow).to_batches(max(1, HANDED // int(max(many.max(), held.max()))))

    return Matches(pairs.mapInArrow(match, schema), list(select), where)


def band_newest(left, right, on, lo, hi, width, left_cols, right_cols, ts, event_time, tiebreak=None):
    """Of every pair of chunks the newest match of each left row, at most one; of one instant the largest tiebreak.

    Left columns keep their names, with the event time and its watermark; right ones are the struct ``r``.
    """
    texts = [*(f"l.{c}" for c in [*left_cols, event_time]), *(f"r.{c}" for c in right_cols)]
    pairs = _joined(left, right, list(on), lo, hi, width, texts, ts, event_time, [tiebreak] if tiebreak else [])
    schema = T.StructType([
        *(T.StructField(f.name, f.dataType, True, left.schema[f.name].metadata if f.name == event_time else {}) for f in pairs.schema["l"].dataType.elementType),
        T.StructField("r", pairs.schema["r"].dataType.elementType, True)])
    arrow = to_arrow_schema(schema)

    def match(batches):
        for batch in batches:
            (l, _), (r, _), first, end = _ranges(batch, lo, hi, width, ts)
            hit = np.flatnonzero(end > first)
            if len(hit):
                found = [*l.take(pa.array(hit)).flatten(), r.take(pa.array(end[hit] - 1))]
                yield from pa.Table.from_arrays([a.cast(f.type) for a, f in zip(found, arrow)], schema=arrow).to_batches(10_000)

    return pairs.mapInArrow(match, schema)
