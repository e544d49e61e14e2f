"""Nearest vectors by largest inner product, by counting collisions of single projections.

Inner products become distances: a vector is divided by the greatest length of all and
gets one more component that makes its length 1, a query is divided by its own length.
Then distance^2 = 2 - 2 * product / (|query| * greatest length).

Vectors stand in shards of bounded size. A shard keeps, for every one of ``PROJECTIONS``
random directions, its vectors' projections in sorted order. A query opens a window
centred at its own projection in every array; windows widen with the radius (virtual
rehashing: only what the wider windows add is counted), and a vector that collides in
at least as many windows as nearly every vector within the radius does is verified with
its exact inner product. The radius stops growing once ``k`` vectors within it are found;
when it spans the sphere, all that is left is verified, so no query gets fewer than it should.

Shards are searched in waves of growing numbers. After a wave every query knows a score
that its k-th nearest has at least, and so the radius to open in further shards; these
return only what may still be among the first k. Queries go to the shards in blocks of
bounded size.

Defined cases: vectors that are null, all zero, or hold a null or non-finite component
take no part, nor do those of another length than most have (the longer, if two lengths
are as frequent); vectors without an id are found but ask nothing; a query finds no row of
its own id; repeated rows each ask and are each found; equal scores go to the smaller id,
none comes last; empty tables give no rows. Other columns are not read.
"""

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F, types as T

from .common import col, parts, store

K = 20
ASK_EVERY = 20
PROJECTIONS = 32
# Half a window in radii, and the share of vectors at the radius itself that must pass.
WINDOW, PASS = 1.0, 0.97
START, WIDEN = 0.25, 1.4
SHARD_ROWS, QUERY_BYTES = 4096, 32 << 20
FIRST_SHARDS, GROWTH = 1, 8
# A task takes so many queries at a time through a shard.
STEP = 512
FIRST_TASKS = 16
SEED = 20

INDEX = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("vectors", T.BinaryType()), T.StructField("values", T.BinaryType()), T.StructField("order", T.BinaryType()),
])
_INDEX = pa.schema([
    ("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("values", pa.binary()), ("order", pa.binary()),
])
FOUND = T.StructType([
    T.StructField("query", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()),
])
_FOUND = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def least_collisions(projections=PROJECTIONS, window=WINDOW, passing=PASS):
    """Windows in which a vector at the radius itself collides at least, but for a share of 1 - ``passing``."""
    p = 2 * NormalDist().cdf(window) - 1
    z = NormalDist().inv_cdf(passing)
    return max(1, math.floor(projections * p - z * math.sqrt(projections * p * (1 - p))))


def usable(vectors, id_col="vec_id", vector_col="embedding"):
    """``vec_id``, ``v`` (float64) and ``row`` (a number of its own) of the vectors that take part."""
    v = col(vector_col).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    plain = vectors.select(col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("row"))
    whole = store(plain.where(F.col("v").isNotNull()).where(ok), "collision-vectors")
    most = whole.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = most["dim"] if most else 0
    return whole.where(F.size("v") == dim), dim


def _directions(dim, projections):
    return np.random.default_rng(SEED).standard_normal((dim + 1, projections))


def build(vectors, dim, longest, shards, projections=PROJECTIONS):
    """One row for each shard: ids, vectors, and for each direction the sorted projections and whose they are."""

    def one(table):
        ids = table.column("vec_id").combine_chunks()
        v = _matrix(table, dim)
        scaled = v / longest
        extra = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        p = (np.column_stack([scaled, extra]) @ _directions(dim, projections)).T
        order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        values = np.take_along_axis(p, order, axis=1).astype(np.float32)
        return pa.Table.from_arrays([
            pa.array([table.column("shard")[0].as_py()], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())),
            *(pa.array([x.tobytes()], pa.binary()) for x in (v, values, order)),
        ], schema=_INDEX)

    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    return vectors.select(shard, "vec_id", "v").groupBy("shard").applyInArrow(one, INDEX)


def _matrix(table, dim):
    c = table.column("v").combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class _Shard:
    def __init__(self, ids, vectors, values, order, dim, projections):
        # Rows without an id come after all others.
        self.n = len(ids)
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], dtype=np.int64)
        self.null = np.array([i is None for i in ids])
        self.v = np.frombuffer(vectors).reshape(-1, dim)
        self.values = np.frombuffer(values, dtype=np.float32).reshape(projections, -1)
        self.order = np.frombuffer(order, dtype=np.int32).reshape(projections, -1).astype(np.int64)
        self.kind = np.uint16 if self.n < 1 << 16 else np.uint32
        self.places = np.empty(self.order.shape, dtype=self.kind)
        np.put_along_axis(self.places, self.order, np.arange(self.n, dtype=self.kind)[None, :], axis=1)

    def windows(self, centres, half):
        """Bounds of the windows of every query (rows) in every array (columns)."""
        lo = np.empty(centres.shape, dtype=np.int64)
        hi = np.empty(centres.shape, dtype=np.int64)
        for j, values in enumerate(self.values):
            lo[:, j] = np.searchsorted(values, (centres[:, j] - half).astype(np.float32), side="left")
            hi[:, j] = np.searchsorted(values, (centres[:, j] + half).astype(np.float32), side="right")
        return lo, hi

    def collide(self, lo, hi):
        """How often each vector stands in the given windows."""
        inside = [self.order[j, a:b] for j, (a, b) in enumerate(zip(lo.tolist(), hi.tolist()))]
        return np.bincount(np.concatenate(inside), minlength=self.n)

    def collide_wide(self, lo, hi):
        """The same for windows that hold much of the arrays: every vector's places are held against them."""
        inside = (self.places - lo[:, None].astype(self.kind)) < (hi - lo)[:, None].astype(self.kind)
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint16)

    def verify(self, at, query, own, k, reach=None):
        """The k best of the candidates by their exact products, without those of the query's own id.

        A matrix product comes first; what its rounding leaves open is multiplied row by
        row, so that equal vectors have equal scores.
        """
        at = at[(self.ids[at] != own) | self.null[at]]
        rough = (self.v @ query)[at]
        least = np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -np.inf
        least = least if reach is None else max(least, reach)
        at = at[rough >= least - 1e-9 * (1 + abs(least))] if np.isfinite(least) else at
        scores = (self.v[at] * query).sum(axis=1)
        if reach is not None:
            at, scores = at[scores >= reach], scores[scores >= reach]
        best = np.lexsort((self.ids[at], -scores))[:k]
        return at[best], scores[best]


class _Queries:
    """A block of queries: numbers, own ids, vectors, and the scores that are surely reached (or none)."""

    def __init__(self, table, dim, longest, projections):
        self.numbers = table.column("query").to_numpy()
        self.own = table.column("vec_id").to_numpy()
        self.v = _matrix(table, dim)
        self.scale = np.sqrt((self.v * self.v).sum(axis=1)) * longest
        unit = self.v / np.sqrt((self.v * self.v).sum(axis=1))[:, None]
        self.centres = unit @ _directions(dim, projections)[:dim]
        self.reach = table.column("reach").to_numpy(zero_copy_only=False).astype(np.float64)

    def radius(self, q, score):
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * score / self.scale[q]))


def _widen(shard, queries, rows, k, enough):
    """Queries that know no score yet: windows widen until k vectors within the radius are found."""
    radius = START
    counts = {q: np.zeros(shard.n, dtype=np.int64) for q in rows}
    best = {}
    lo = hi = None
    while rows:
        spans = radius >= 2.0
        a, b = shard.windows(queries.centres[rows], np.full(len(rows), WINDOW * radius))
        if lo is None:
            lo, hi = a, a
        still = []
        for i, q in enumerate(rows):
            counts[q] += shard.collide(a[i], lo[i]) + shard.collide(hi[i], b[i])
            best[q] = shard.verify(np.flatnonzero((counts[q] >= enough) | spans), queries.v[q], queries.own[q], k)
            inside = (queries.radius(q, best[q][1]) <= radius).sum()
            if inside < k and not spans:
                still.append(i)
        rows, lo, hi = [rows[i] for i in still], a[still], b[still]
        radius *= WIDEN
    return best


def _search(shard, queries, piece, pieces, k, enough):
    """One piece of the queries against one shard."""
    mine = np.arange(piece, len(queries.numbers), pieces)
    for start in range(0, len(mine), STEP):
        block = mine[start : start + STEP]
        known = np.isfinite(queries.reach[block])
        best = _widen(shard, queries, block[~known].tolist(), k, enough)
        rows = block[known]
        if len(rows):
            lo, hi = shard.windows(queries.centres[rows], WINDOW * queries.radius(rows, queries.reach[rows]))
            for i, q in enumerate(rows.tolist()):
                at = np.flatnonzero(shard.collide_wide(lo[i], hi[i]) >= enough)
                best[q] = shard.verify(at, queries.v[q], queries.own[q], k, queries.reach[q])
        for q, (at, scores) in best.items():
            yield queries.numbers[q], at, scores


def _wave(index, pieces, block, dim, longest, k, projections):
    """What the shards of a wave find for one block of queries (an Arrow table), each piece of it in a task of its own."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(block)
    enough = least_collisions(projections)

    def run(batches):
        queries = None
        for batch in batches:
            queries = queries or _Queries(sent.value, dim, longest, projections)
            for row in range(batch.num_rows):
                ids, vectors, values, order = (batch.column(c)[row].as_py() for c in ("ids", "vectors", "values", "order"))
                shard = _Shard(ids, vectors, values, order, dim, projections)
                numbers, at, scores = [], [], []
                for number, a, s in _search(shard, queries, batch.column("piece")[row].as_py(), pieces, k, enough):
                    numbers.append(np.full(len(a), number))
                    at.append(a)
                    scores.append(s)
                if not at:
                    continue
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(numbers), pa.int64()), pa.array(shard.ids[at], pa.int64(), mask=shard.null[at]),
                    pa.array(np.concatenate(scores), pa.float64()),
                ], schema=_FOUND)

    return index.select("ids", "vectors", "values", "order", "piece").mapInArrow(run, FOUND)


def waves(shards):
    """Ranges of shards: a few first, then each time several times as many as before."""
    begin, end = 0, FIRST_SHARDS
    while begin < shards:
        yield begin, min(end, shards)
        begin, end = end, end * GROWTH


def nearest(vectors, k=K, every=ASK_EVERY, id_col="vec_id", vector_col="embedding", shard_rows=SHARD_ROWS, projections=PROJECTIONS, query_bytes=QUERY_BYTES):
    """For every row whose id ``every`` divides its ``k`` nearest others found: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vector_col)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    size = rows.agg(F.count("*").alias("n"), F.max(length).alias("longest")).first()
    asking = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query"), "vec_id", "v")
    best = spark.createDataFrame([], FOUND)
    if size["n"]:
        shards = parts(size["n"], shard_rows)
        index = store(build(rows, dim, size["longest"], shards, projections), "collision-index")
        blocks = parts(asking.count() * dim * 8, query_bytes)
        asking = store(asking.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))), "collision-queries")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        for begin, end in waves(shards):
            # Once k are found, further ones must reach the score of the last.
            reach = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
                "query", F.when(F.col("n") >= k, F.col("least")).alias("reach")
            )
            asks = asking.join(reach, "query", "left")
            # The first waves have few shards, so several tasks share the queries of one.
            pieces = max(1, FIRST_TASKS // (end - begin))
            wave = index.where((F.col("shard") >= begin) & (F.col("shard") < end)).withColumn(
                "piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
            ).repartitionByRange((end - begin) * pieces, "shard", "piece")
            found = best
            for b in range(blocks):
                block = asks.where(F.col("block") == b).select("query", "vec_id", "v", "reach").toArrow()
                if block.num_rows:
                    found = found.unionByName(_wave(wave, pieces, block, dim, size["longest"], k, projections))
            best = store(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "collision-found")
        best = best.withColumn("rank", F.row_number().over(order))
        return best.join(asking.select("query", F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
    return best.select(F.col("query").alias("query_id"), F.lit(0).alias("rank"), "vec_id", "score")
