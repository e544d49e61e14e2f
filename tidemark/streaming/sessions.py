"""Sessions of a stream handed out whenever they change, with any measures.

Rows become one-row partials of the measures before the state and cells of the gap's width in
packed chunks (``packs``). A first stage, keyed by key and block of time, folds the cells of a
micro-batch into the open pieces of its block; only pieces that a micro-batch touches are read
and written. A piece farther than the gap from both ends of its block is a session. The
others may go on in the next block: they meet in a second stage, which holds a key's edge
pieces only. So one busy key uses as many tasks as it has blocks at a time.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import measures as M
from ..functions.time import interval_ms
from ..schemas import EVENT_TIME, TIME
from . import packs

CELLS_PER_BLOCK = 256
# A piece that was handed out as a session and is an edge piece now.
TOLD = "-I"

_L = T.LongType()
_NUMBERS = T.StructType([T.StructField("starts", T.BinaryType()), T.StructField("ends", T.BinaryType())])
_START = T.StructType([T.StructField("s", _L)])


class Folds:
    """How the partials of several pieces become those of one.

    ``kinds`` maps a partial's column to ("sum" | "min" | "max", itself) or to
    ("min_by" | "max_by", the column it goes by).
    """

    def __init__(self, kinds):
        self.kinds = kinds

    def __call__(self, pieces, run):
        """One row for each number in ``run``: first ``s``, last ``e`` and the folded partials."""
        groups = pieces.groupby(run, sort=True)
        out = {"s": groups["s"].min(), "e": groups["e"].max()}
        for c, (kind, by) in self.kinds.items():
            if kind == "sum":
                out[c] = groups[c].sum(min_count=1)
            elif kind in ("min", "max"):
                out[c] = getattr(groups[c], kind)()
            else:
                ordered = pieces.assign(run_no=run).sort_values(by, kind="stable", na_position="first" if kind == "max_by" else "last")
                out[c] = ordered.drop_duplicates("run_no", keep="last" if kind == "max_by" else "first").set_index("run_no")[c]
        return pd.DataFrame(out).reset_index(drop=True)


def _runs(starts, ends, gap):
    """Number of the session each piece belongs to; pieces are in order of their starts."""
    opens = np.zeros(len(starts), dtype=np.int64)
    opens[1:] = starts[1:] - np.maximum.accumulate(ends)[:-1] > gap
    return np.cumsum(opens)


class _Kept:
    """Pieces in state: their bounds as two packed arrays, the partials by start."""

    def __init__(self, handle, schema, columns):
        self.bounds = handle.getValueState("bounds", _NUMBERS)
        self.parts = handle.getMapState("parts", _START, schema)
        self.columns = columns

    def read(self):
        if not self.bounds.exists():
            none = np.zeros(0, dtype=np.int64)
            return none, none
        starts, ends = self.bounds.get()
        return np.frombuffer(bytes(starts), dtype=np.int64), np.frombuffer(bytes(ends), dtype=np.int64)

    def write(self, starts, ends):
        if len(starts):
            self.bounds.update((starts.astype(np.int64).tobytes(), ends.astype(np.int64).tobytes()))
        else:
            self.bounds.clear()

    def fetch(self, starts, ends):
        rows = [(s, e, *self.parts.getValue((s,))) for s, e in zip(starts.tolist(), ends.tolist())]
        return pd.DataFrame(rows, columns=["s", "e", *self.columns])

    def put(self, pieces):
        for row in _plain(pieces[["s", *self.columns]]):
            self.parts.updateValue((row[0],), row[1:])

    def drop(self, starts):
        for s in starts.tolist():
            self.parts.removeKey((s,))


def _plain(pieces):
    """Rows as tuples of Python values, None for what is missing."""
    return [tuple(None if x is None or x is pd.NA or x != x else x for x in row) for row in pieces.astype(object).itertuples(index=False, name=None)]


class Cells:
    """Rows of a chunk as cells: those of a key and block in one cell of the gap's width are one piece."""

    def __init__(self, by, gap, folds, names, ts, event_time):
        self.by, self.gap, self.folds, self.names, self.ts, self.event_time = by, gap, folds, names, ts, event_time

    def __call__(self, table):
        times = table[self.ts].to_numpy()
        code = packs.codes(table, self.by)
        order = np.lexsort((times // self.gap, code))
        table, times, code = table.take(pa.array(order)), times[order], code[order]
        opens = np.ones(len(times), dtype=bool)
        opens[1:] = (np.diff(code) != 0) | (np.diff(times // self.gap) != 0)
        first = np.flatnonzero(opens)
        rows = packs.to_pandas(table.select(list(self.folds.kinds))).assign(s=times, e=times)
        out = self.folds(rows, np.cumsum(opens)).reset_index(drop=True)
        head = packs.to_pandas(table.select(self.by).take(pa.array(first)))
        head[self.event_time] = packs.instants(np.maximum.reduceat(packs.micros(table[self.event_time]), first))
        return pd.concat([head, out], axis=1)[self.names]


class Blocks(StatefulProcessor):
    """First stage: open pieces of a key and block."""

    def __init__(self, keys, gap, width, folds, schema, names):
        self.keys, self.gap, self.width, self.folds = keys, gap, width, folds
        self.schema, self.names = schema, names

    def init(self, handle):
        self.handle = handle
        self.kept = _Kept(handle, self.schema, self.schema.names)
        self.timer = handle.getValueState("timer", _START)

    def _edge(self, block, starts, ends):
        low = block * self.width
        return (starts < low + self.gap) | (ends >= low + self.width - self.gap)

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows), ignore_index=True)
        if rows.empty:
            return
        fresh = self.folds(rows, (rows["s"] // self.gap).to_numpy())
        starts, ends = self.kept.read()
        # A piece is touched if a fresh cell lies within the gap of it.
        first = np.searchsorted(fresh["e"].to_numpy(), starts - self.gap)
        near = np.append(fresh["s"].to_numpy(), np.iinfo(np.int64).max)[first]
        touched = near <= ends + self.gap
        old = self.kept.fetch(starts[touched], ends[touched])
        every = pd.concat([old, fresh], ignore_index=True) if len(old) else fresh
        every = every.sort_values("s", kind="stable", ignore_index=True)
        merged = self.folds(every, _runs(every["s"].to_numpy(), every["e"].to_numpy(), self.gap))
        self.kept.drop(starts[touched])
        self.kept.put(merged)
        s = np.concatenate([starts[~touched], merged["s"].to_numpy()])
        e = np.concatenate([ends[~touched], merged["e"].to_numpy()])
        order = np.argsort(s)
        self.kept.write(s[order], e[order])
        self._wake(int(e.max()))
        block = key[len(self.keys)]
        was = self._edge(block, old["s"].to_numpy(np.int64), old["e"].to_numpy(np.int64)) if len(old) else np.zeros(0, dtype=bool)
        now = self._edge(block, merged["s"].to_numpy(), merged["e"].to_numpy())
        inner, edge = old[~was], old[was]
        moved = inner["s"].isin(merged[now]["s"])
        # A session that has become an edge piece is withdrawn where it may come out again.
        out = [
            (inner[~moved & ~inner["s"].isin(merged["s"])], "-D", False), (merged[~now], "+U", False),
            (inner[moved], TOLD, True), (edge[~edge["s"].isin(merged["s"])], "-D", True), (merged[now], "+U", True),
        ]
        for pieces, change, to_edges in out:
            if len(pieces):
                yield self._out(key, pieces, change, to_edges, timerValues.getCurrentWatermarkInMs())

    def _out(self, key, pieces, change, edge, mark):
        rows = _plain(pieces[["s", "e", *self.schema.names]])
        head, part = tuple(key[: len(self.keys)]), 0 if edge else key[len(self.keys)]
        return pd.DataFrame([(*head, edge, part, change, mark, *r) for r in rows], columns=self.names)

    def _wake(self, last):
        """One timer a block: when nothing can join its last piece any more."""
        at = last + self.gap + 1
        if self.timer.exists():
            now = self.timer.get()[0]
            if now == at:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        starts, ends = self.kept.read()
        open_ = ends + self.gap >= timerValues.getCurrentWatermarkInMs()
        self.kept.drop(starts[~open_])
        self.kept.write(starts[open_], ends[open_])
        if open_.any():
            self._wake(int(ends[open_].max()))
        return iter(())

    def close(self):
        pass


class Stitch(StatefulProcessor):
    """Second stage: a key's edge pieces make sessions over the ends of blocks; other sessions pass through."""

    def __init__(self, keys, gap, folds, schema, names):
        self.keys, self.gap, self.folds, self.schema, self.names = keys, gap, folds, schema, names

    def init(self, handle):
        self.kept = _Kept(handle, self.schema, self.schema.names)

    def handleInputRows(self, key, rows, timerValues):
        if not key[len(self.keys)]:
            for pdf in rows:
                yield pdf[self.names]
            return
        changes = pd.concat(list(rows), ignore_index=True)
        if changes.empty:
            return
        changes = changes.rename(columns={"session_start": "s", "session_end": "e"})
        told, changes = changes[changes["change"] == TOLD], changes[changes["change"] != TOLD]
        gone, put = changes[changes["change"] == "-D"], changes[changes["change"] == "+U"]
        moved = changes["s"].to_numpy(np.int64)
        starts, ends = self.kept.read()
        before = _runs(starts, ends, self.gap)
        stay = ~np.isin(starts, moved)
        s = np.concatenate([starts[stay], put["s"].to_numpy(np.int64)])
        e = np.concatenate([ends[stay], put["e"].to_numpy(np.int64)])
        order = np.argsort(s)
        s, e = s[order], e[order]
        after = _runs(s, e, self.gap)
        # Sessions with a moved piece change, and so does every session that shares a piece with one that did.
        hit_before = np.isin(before, before[np.isin(starts, moved)])
        hit_after = np.isin(after, after[np.isin(s, moved) | np.isin(s, starts[hit_before])])
        hit_before |= np.isin(before, before[np.isin(starts, s[hit_after])])
        hit_after |= np.isin(after, after[np.isin(s, starts[hit_before])])
        old = self._sessions(starts[hit_before], ends[hit_before], before[hit_before])
        self.kept.drop(gone["s"].to_numpy(np.int64))
        self.kept.put(put)
        new = self._sessions(s[hit_after], e[hit_after], after[hit_after])
        mark = int(changes["mark"].max())
        # All pieces of a session go once nothing can join it any more.
        last = np.zeros(int(after.max(initial=-1)) + 1, dtype=np.int64)
        np.maximum.at(last, after, e)
        open_ = last[after] + self.gap >= mark if len(s) else np.zeros(0, dtype=bool)
        self.kept.drop(s[~open_])
        self.kept.write(s[open_], e[open_])
        head = tuple(key[: len(self.keys)])
        for pieces, change in ((told[~told["s"].isin(new["s"])], "-D"), (old[~old["s"].isin(new["s"])], "-D"), (new, "+U")):
            if len(pieces):
                yield pd.DataFrame([(*head, change, *r) for r in _plain(pieces[["s", "e", *self.schema.names]])], columns=self.names)

    def _sessions(self, starts, ends, run):
        pieces = self.kept.fetch(starts, ends)
        return self.folds(pieces, run) if len(pieces) else pieces

    def close(self):
        pass


def stream_session_updates(df, keys, gap, measures, cells_per_block=CELLS_PER_BLOCK, ts=TIME, event_time=EVENT_TIME):
    """Every session of a watermarked stream on every change: keys, ``session_start``, ``session_end``,
    the measures and ``change``: ``+U`` for its new state, ``-D`` if it went up in another session.

    Sessions are those of ``windows.session_agg``; rows without a time are left out. A stream
    of these needs append mode, ``emit.on_update(..., mode="append")``.
    """
    keys, gap = list(keys), interval_ms(gap)
    width = gap * max(4, cells_per_block)
    rows = df.where(F.col(ts).isNotNull()).select(
        *keys, F.floor(F.col(ts) / width).cast("long").alias("block_no"), ts, event_time, *M.row_partials(measures)
    )
    folds, names = Folds(M.folds(measures)), [c.name for c in rows.schema if c.name not in (*keys, "block_no", ts, event_time)]
    parts = T.StructType([T.StructField(n, rows.schema[n].dataType, True) for n in names])
    own = [T.StructField(k, df.schema[k].dataType, True) for k in keys]
    change = T.StructField("change", T.StringType(), True)
    bounds = [T.StructField(n, _L, True) for n in ("session_start", "session_end")]
    between = T.StructType([
        *own, T.StructField("edge_row", T.BooleanType(), True), T.StructField("block_no", _L, True), change,
        T.StructField("mark", _L, True), *bounds, *parts.fields,
    ])
    out = T.StructType([*own, change, *bounds, *parts.fields])
    by = [*keys, "block_no"]
    piece = T.StructType([
        *own, T.StructField("block_no", _L, True), T.StructField(event_time, T.TimestampType(), True),
        T.StructField("s", _L, True), T.StructField("e", _L, True), *parts.fields,
    ])
    cells = packs.gated(rows, Cells(by, gap, folds, piece.names, ts, event_time), piece, event_time)
    pieces = cells.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=Blocks(keys, gap, width, folds, parts, between.names),
        outputStructType=between, outputMode="append", timeMode="EventTime",
    )
    told = pieces.groupBy(*keys, "edge_row", "block_no").transformWithStateInPandas(
        statefulProcessor=Stitch(keys, gap, folds, parts, out.names), outputStructType=out, outputMode="append", timeMode="None",
    )
    return told.select(*keys, "session_start", "session_end", *M.results(measures), "change")
