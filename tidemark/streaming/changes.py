"""Aggregates over the current rows of a change stream, and the cut from a snapshot to its log.

``stream_current_totals`` works in three stages. The first keeps the newest image of every
row and hands out what a micro-batch takes back and adds; rows stand in ``BUCKETS`` groups by
a hash of their key, as every call for a group costs more than the rows in it; the second keeps totals of a group
in ``salts`` parts, by a hash of the row's key, so a group with most rows uses several tasks;
the third, which sees one row for each part that changed, merges parts and tells the changes.
Counts and sums are taken back by subtraction, so doubles are summed as decimals of ten
places; for min and max each value is counted, and the counts of a part are read and
written at once.
"""

import pickle
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SALTS = 16
BUCKETS = 1024

_L, _I, _S = T.LongType(), T.IntegerType(), T.StringType()
_EXACT = T.DecimalType(38, 10)


def _schema(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def _native(x):
    if x is None or x is pd.NA or x != x:
        return None
    return x.item() if hasattr(x, "item") else x


def _row_key(keys):
    """All key columns as one text; nulls stay apart from texts."""
    return F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))


def _bucket(keys):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


class Images(StatefulProcessor):
    """First stage: newest image of each row of a bucket; tells the images it takes back and those it adds."""

    def __init__(self, order, op, deleted, image, output):
        self.order, self.op, self.deleted, self.image, self.output = order, op, deleted, image, output

    def init(self, handle):
        head = [T.StructField("at", self.image["order_no"].dataType, True), T.StructField("live", T.BooleanType(), True)]
        self.now = handle.getMapState("images", _schema(("row_key", _S)), T.StructType(head + self.image.fields[1:]))

    def handleInputRows(self, key, rows, timerValues):
        newest = {}
        for pdf in rows:
            for row_key, *row in pdf[["row_key", *self.image.names, self.op]].astype(object).itertuples(index=False, name=None):
                if row[0] is not None and (row_key not in newest or row[0] >= newest[row_key][0]):
                    newest[row_key] = row
        out = []
        for row_key, row in newest.items():
            out += self._replace(row_key, row)
        if out:
            yield pd.DataFrame(out, columns=self.output)

    def _replace(self, row_key, newest):
        """The image a row loses and the one it gets."""
        old = self.now.getValue((row_key,))
        if old is not None and newest[0] <= old[0]:
            return []
        at, *image, op = newest
        image, live = tuple(_native(x) for x in image), op not in self.deleted
        # A deleted row stays known, so that an older change that comes later does not bring it back.
        self.now.updateValue((row_key,), (_native(at), live, *image))
        out = []
        if old is not None and old[1]:
            out.append((*old[2:], -1))
        if live:
            out.append((*image, 1))
        return [] if len(out) == 2 and out[0][:-1] == out[1][:-1] else out

    def close(self):
        pass


class Parts(StatefulProcessor):
    """Second stage: totals of one part of a group, from signed images."""

    def __init__(self, heads, totals, schema, output):
        self.heads, self.totals, self.schema, self.output = heads, totals, schema, output

    def init(self, handle):
        self.now = handle.getValueState("totals", self.schema)
        self.seen = {
            n: handle.getValueState(f"seen_{n}", _schema(("counts", T.BinaryType())))
            for n, (how, _) in self.totals.items() if how in ("min", "max")
        }

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows), ignore_index=True)
        if rows.empty:
            return
        old = tuple(self.now.get()) if self.now.exists() else (0, *[None] * len(self.totals))
        size = old[0] + int(rows["sign"].sum())
        new = [size]
        for (n, (how, c)), was in zip(self.totals.items(), old[1:]):
            if how == "count":
                new.append(size)
            elif how == "sum":
                moved = [v * s for v, s in zip(rows[c], rows["sign"].tolist()) if not pd.isna(v)]
                new.append(sum(moved, was or Decimal(0)) if moved else was)
            else:
                new.append(self._extreme(n, how, rows[c], rows["sign"], was))
        new = tuple(_native(x) for x in new)
        if new == old:
            return
        self.now.update(new) if size else self.now.clear()
        yield pd.DataFrame([(*key, *new)], columns=self.output)

    def _extreme(self, name, how, values, signs, was):
        """The least or greatest value left; values are only listed if the old one is gone."""
        state, gone = self.seen[name], False
        seen = pickle.loads(bytes(state.get()[0])) if state.exists() else {}
        moved = {}
        for v, s in zip(values, signs.tolist()):
            if not pd.isna(v):
                moved[_native(v)] = moved.get(_native(v), 0) + s
        best = min if how == "min" else max
        kept = [] if was is None else [was]
        for v, s in moved.items():
            n = s + seen.get(v, 0)
            if n:
                seen[v] = n
                kept.append(v)
            else:
                seen.pop(v, None)
                gone = gone or v == was
        if any(moved.values()):
            state.update((pickle.dumps(seen),))
        if gone:
            kept = list(seen)
        return best(kept) if kept else None

    def close(self):
        pass


class Groups(StatefulProcessor):
    """Third stage: parts of a group merged; tells ``+I``, ``-U`` with ``+U``, and ``-D`` when no row is left."""

    def __init__(self, heads, totals, schema, output):
        self.heads, self.totals, self.schema, self.output = heads, totals, schema, output

    def init(self, handle):
        self.parts = handle.getMapState("parts", _schema(("salt", _I)), self.schema)

    def _total(self, parts):
        parts = [p for p in parts.values() if p[0]]
        if not parts:
            return None
        out = []
        for k, (how, _) in enumerate(self.totals.values(), 1):
            values = [p[k] for p in parts if p[k] is not None]
            fold = {"count": sum, "sum": sum, "min": min, "max": max}[how]
            out.append(fold(values) if values else None)
        return tuple(out)

    def handleInputRows(self, key, rows, timerValues):
        parts = {k[0]: tuple(v) for k, v in self.parts.iterator()}
        old = self._total(parts)
        for pdf in rows:
            for salt, *part in pdf[["salt", *self.schema.names]].astype(object).itertuples(index=False, name=None):
                part = tuple(_native(x) for x in part)
                parts[salt] = part
                self.parts.updateValue((salt,), part) if part[0] else self.parts.removeKey((salt,))
        new = self._total(parts)
        if new == old:
            return
        told = [(c, t) for c, t in (("-U" if new else "-D", old), ("+U" if old else "+I", new)) if t]
        yield pd.DataFrame([(*key, c, *t) for c, t in told], columns=self.output)

    def close(self):
        pass


def stream_current_totals(changes, keys, order, groups, totals, op="_op", deleted=("D",), salts=SALTS):
    """Changelog of totals over the current rows of a change stream.

    ``keys`` tell a row, ``order`` its versions. ``totals`` maps a result to
    ("count" | "sum" | "min" | "max", column); nulls are left out of all but counts. A
    change that is not newer than what is known of its row does nothing. Needs append
    mode, ``emit.on_update(..., mode="append")``.
    """
    keys, groups, totals = list(keys), list(groups), dict(totals)
    values = list(dict.fromkeys(c for how, c in totals.values() if how != "count"))
    exact = {
        c for how, c in totals.values() if how == "sum" and isinstance(changes.schema[c].dataType, (T.DoubleType, T.FloatType, T.DecimalType))
    }
    # pandas reads whole numbers with nulls among them as floats; decimals keep them as they are.
    own = lambda c: _EXACT if isinstance(changes.schema[c].dataType, (T.IntegralType, T.DecimalType)) else changes.schema[c].dataType
    kind = {c: _EXACT if c in exact else own(c) for c in values}
    if set(keys) & set(groups):
        raise ValueError("keys and groups must be different columns")
    rows = changes.select(
        _bucket(keys).alias("bucket_no"), _row_key(keys).alias("row_key"), F.col(order).cast(own(order)).alias("order_no"), *groups,
        F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int").alias("salt"),
        *[F.col(c).cast(kind[c]).alias(f"v_{c}") for c in values], F.col(op).alias("op_code"),
    )
    inner = {n: (how, None if how == "count" else f"v_{c}") for n, (how, c) in totals.items()}
    heads = [(g, changes.schema[g].dataType) for g in groups]
    cells = [(f"v_{c}", kind[c]) for c in values]
    signed = _schema(*heads, ("salt", _I), *cells, ("sign", _I))
    image = T.StructType([rows.schema["order_no"], *signed.fields[:-1]])
    result = [(n, _L if how == "count" else kind[c]) for n, (how, c) in totals.items()]
    part = _schema(("size", _L), *result)
    step = lambda df, by, processor, out: df.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="None")
    moved = step(rows, ["bucket_no"], Images("order_no", "op_code", tuple(deleted), image, signed.names), signed)
    by_part = _schema(*heads, ("salt", _I), *[(f.name, f.dataType) for f in part.fields])
    parts = step(moved, [*groups, "salt"], Parts(groups, inner, part, by_part.names), by_part)
    out = _schema(*heads, ("change", _S), *result)
    told = step(parts, groups, Groups(groups, inner, part, out.names), out)
    shown = {n: _L if how == "count" else changes.schema[c].dataType for n, (how, c) in totals.items()}
    wide = {n: _L if how == "sum" and isinstance(t, T.IntegralType) else t for (n, (how, _)), t in zip(totals.items(), shown.values())}
    return told.select(*groups, "change", *[F.col(n).cast(t).alias(n) for n, t in wide.items()])


class Once(StatefulProcessor):
    """Changes of the rows of a bucket: the snapshot's image of a row once, then each change newer than all before."""

    def __init__(self, cut):
        self.cut = cut

    def init(self, handle):
        self.now = handle.getMapState("newest", _schema(("row_key", _S)), _schema(("at", _EXACT), ("copied", T.BooleanType())))

    def handleInputRows(self, key, rows, timerValues):
        was, now, keep = {}, {}, []
        rows = pd.concat(list(rows), ignore_index=True)
        for row_key, place, copy, body in sorted(rows[["row_key", "place", "copy_row", "body"]].itertuples(index=False, name=None)):
            if row_key not in now:
                known = self.now.getValue((row_key,))
                was[row_key] = now[row_key] = (Decimal(self.cut), False) if known is None else tuple(known)
            at, copied = now[row_key]
            if copy:
                if not copied:
                    keep.append(body)
                copied = True
            elif place > at:
                at = place
                keep.append(body)
            now[row_key] = at, copied
        for row_key, value in now.items():
            if value != was[row_key]:
                self.now.updateValue((row_key,), value)
        if keep:
            yield pd.DataFrame({"body": keep})

    def close(self):
        pass


def cut_over(snapshot, changes, keys, cut, order="_lsn"):
    """A snapshot taken at log position ``cut`` and the log around it, each change once.

    Both are streams of equal columns. Changes up to the cut are in the snapshot; later
    ones pass if they are newer than all of their row so far, so what the log delivers
    again is dropped. A row's changes must come in log order, as logs deliver them;
    snapshot and log may come in any order to each other. Changes without a position are dropped.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in changes.schema.fields])
    # The row travels as text, so that no value changes its type on the way through pandas.
    plain = lambda df, copied: df.select(
        _bucket(keys).alias("bucket_no"), _row_key(keys).alias("row_key"), F.coalesce(F.col(order).cast(_EXACT), F.lit(cut).cast(_EXACT)).alias("place"),
        F.lit(copied).alias("copy_row"), F.to_json(F.struct(*changes.columns)).alias("body"),
    )
    both = plain(snapshot, True).unionByName(plain(changes.where(F.col(order) > cut), False))
    once = both.groupBy("bucket_no").transformWithStateInPandas(
        statefulProcessor=Once(cut), outputStructType=_schema(("body", _S)), outputMode="append", timeMode="None",
    )
    return once.select(F.from_json("body", schema).alias("row")).select("row.*")
