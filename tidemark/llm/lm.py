"""A word language model scored as a weighted backoff automaton.

Counts of n-grams (their histories included) of the whole training part are
gathered in hashed buckets; blocks of documents ask for the counts of their own
n-grams. From these a block has the part of the automaton that its texts walk
through: a state is a seen history, an arc a seen n-gram, and the failure arc of a
state leads to the shorter history. Weights are Dirichlet-smoothed:

    p(v | h) = (c(h v) + strength * p(v | shorter h)) / (c(h) + strength)

so the failure arc of ``h`` weighs strength / (c(h) + strength), and the root is
the add-one unigram distribution. Unseen words share the root's remaining mass.
"""

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F, types as T

from .blocks import by_bucket, make_blocks, store_by_block, unpack
from .common import parts, planes, store, text_bytes, texts, tokens, unplanes

ORDER = 3
STRENGTH = 2.0
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20

_ASK = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("size", T.IntegerType()),
    T.StructField("block", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()),
])
_ANSWER = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("size", T.IntegerType()),
    T.StructField("counts", T.BinaryType()), T.StructField("total", T.LongType()), T.StructField("distinct", T.LongType()),
])
SCORED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
])

_MIX = np.uint64(0x9E3779B97F4A7C15)
START, END = np.uint64(1), np.uint64(2)


def _mix(a):
    a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    a = (a ^ (a >> np.uint64(29))) * _MIX
    return a ^ (a >> np.uint64(32))


class Tokens:
    """Tokens of a block's texts, one after the other, as hashes, with the n-grams that end at each."""

    def __init__(self, values, order):
        known, flat, sizes = {}, [], []
        for text in values:
            w = tokens(text)
            for x in set(w).difference(known):
                known[x] = max(3, xxhash.xxh3_64_intdigest(x))
            flat.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
            flat.append(np.array([END]))
            sizes.append(len(w) + 1)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        word = np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint64)
        place = np.arange(len(word)) - np.repeat(self.starts, self.sizes)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        # grams[n]: the n + 1 tokens that end here; a start mark stands before the first.
        self.grams = [_mix(word)]
        for n in range(1, order):
            key = self.grams[-1].copy()
            before = np.full(len(word), START)
            before[n:] = word[:-n] if n < len(word) else before[n:]
            before[place < n] = START
            self.grams.append(_mix(key * _MIX + before + np.uint64(n)))
        self.order = order
        self.place = place


def _keys(t):
    """Distinct n-grams of a block by size, with the place of each token's n-gram among them."""
    return [np.unique(g, return_inverse=True) for g in t.grams]


def _held_out(ids, modulus, remainder):
    """Whether crc32 of the id as text gives the remainder; a null id counts as empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus == remainder for i in ids], dtype=bool)


def _ask(order, buckets, modulus, remainder):
    def ask(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, values = unpack(blob.as_py())
                t = Tokens(values, order)
                train = ~_held_out(ids, modulus, remainder)[t.doc]
                rows = []
                for size, (keys, at) in enumerate(_keys(t)):
                    counts = np.bincount(at[train], minlength=len(keys))
                    by, bounds = by_bucket(keys, buckets)
                    for b in range(buckets):
                        some = by[bounds[b] : bounds[b + 1]]
                        if len(some):
                            # Keys of a bucket leave one remainder, so their quotients tell them apart.
                            rows.append((b, size, planes(np.diff(keys[some] // np.uint64(buckets), prepend=np.uint64(0))), planes(counts[some])))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([block] * len(rows), pa.int64()),
                    pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary()),
                ], names=_ASK.names)

    return ask


def _answer(table):
    """Sum the counts of one bucket and n-gram size over all blocks; answer each in its own order."""
    asked = [np.cumsum(unplanes(k.as_py())) for k in table.column("keys")]
    counts = [unplanes(c.as_py()).astype(np.int64) for c in table.column("counts")]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    ends = np.cumsum([len(a) for a in asked])
    blobs = [planes(total[at[e - len(a) : e]]) for a, e in zip(asked, ends)]
    n = len(blobs)
    same = lambda name: table.column(name).combine_chunks()
    return pa.table({
        "block": same("block"), "bucket": same("bucket"), "size": same("size"), "counts": pa.array(blobs, pa.binary()),
        "total": pa.array([int(total.sum())] * n, pa.int64()), "distinct": pa.array([int((total > 0).sum())] * n, pa.int64()),
    })


def walk(t, counts, tokens_total, distinct, strength, documents):
    """log10 weight of every step of the left-to-right walk over a block's texts.

    The walk is done as array look-ups by position; no states or arcs are stored.
    After a token the automaton stands in the longest seen history that ends there;
    a step takes the arc of the next token if there is one, and else the failure
    arc to the shorter history, down to the root.
    """
    p = (counts[0] + 1.0) / (tokens_total + distinct + 1.0)
    for n in range(1, t.order):
        # The history of token i is the n-gram that ends at token i - 1.
        history = np.concatenate(([0], counts[n - 1][:-1])).astype(np.float64)
        first = t.place == 0
        history[first] = documents
        seen = history > 0
        arc = counts[n] / (history + strength)
        fail = strength / (history + strength)
        p = np.where(seen, arc + fail * p, p)
    return np.log10(p)


def _score(order, buckets, strength, tokens_total, distinct, documents):
    def score(docs, answers):
        answer = {}
        for b, size, blob in zip(*(answers.column(c).to_pylist() for c in ("bucket", "size", "counts"))):
            answer[b, size] = blob
        out = {n: [] for n in SCORED.names}
        for blob in docs.column("blob").to_pylist():
            ids, values = unpack(blob)
            t = Tokens(values, order)
            counts = []
            for size, (keys, at) in enumerate(_keys(t)):
                by, bounds = by_bucket(keys, buckets)
                total = np.zeros(len(keys), dtype=np.int64)
                for b in range(buckets):
                    some = by[bounds[b] : bounds[b + 1]]
                    if len(some):
                        total[some] = unplanes(answer[b, size])
                counts.append(total[at])
            base = np.log10((counts[0] + 1.0) / (tokens_total + (distinct + 1.0)))
            steps = walk(t, counts, tokens_total, distinct, strength, documents)
            out["doc_id"] += ids
            out["n_tokens"] += t.sizes.tolist()
            out["n_known"] += np.add.reduceat((counts[0] > 0).astype(np.int64), t.starts).tolist()
            out["base_score"] += np.add.reduceat(base, t.starts).tolist()
            out["score"] += np.add.reduceat(steps, t.starts).tolist()
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds)})

    return score


def score(docs, id_col="doc_id", text_col="text", modulus=7, remainder=2, order=ORDER, strength=STRENGTH,
          block_bytes=BLOCK_BYTES, bucket_bytes=BUCKET_BYTES):
    """Token counts and log10 probabilities of every row under a model of the training rows.

    Training rows are those whose crc32 of the id as text has another remainder.
    ``base_score`` is the add-one unigram score, ``score`` that of the backoff
    automaton. A null or empty text is its end token alone; a null id hashes as
    empty text; repeated rows are counted and scored one by one. Without training
    rows every count is 0.
    """
    rows = texts(docs, id_col, text_col)
    total, _ = text_bytes(rows)
    buckets = parts(total, bucket_bytes)
    blocks = store_by_block(make_blocks(docs, id_col, text_col, block_bytes), parts(total, 2 * block_bytes))
    asked = blocks.mapInArrow(_ask(order, buckets, modulus, remainder), _ASK)
    answers = store(asked.repartition(buckets * order, "bucket", "size").groupBy("bucket", "size").applyInArrow(_answer, _ANSWER), "counts", once=True)
    known = answers.where("size = 0").groupBy("bucket").agg(F.max("total").alias("total"), F.max("distinct").alias("distinct"))
    sums = known.agg(F.sum("total").alias("t"), F.sum("distinct").alias("d")).first()
    tokens_total, distinct = sums["t"] or 0, sums["d"] or 0
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder
    documents = rows.where(~held).count()
    scored = (
        blocks.groupBy("block").cogroup(answers.select("block", "bucket", "size", "counts").groupBy("block"))
        .applyInArrow(_score(order, buckets, strength, tokens_total, distinct, documents), SCORED)
    )
    return scored.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens_total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
