"""Ranked lexical search by pipelined term partitioning.

Documents stand in shards of bounded size; a shard's postings are one row for each
term that an item may hold. Terms belong to owners, the heaviest terms to the first.
Items go in bundles of bounded size. A bundle meets the postings of one owner after the
other, by a cogroup on (owner, shard), and carries a sparse accumulator of integer
scores for each of its items from stage to stage; the last owner's stage selects.

A score only grows, so an item's k-th greatest score so far bounds its final one from
below. A document that can't reach it with all that later owners could add is dropped
from the accumulator: it can't be among the first k, whatever it would still get.

Defined cases: a null or empty text holds no term, so such a document is neither counted
nor found and such an item finds nothing; repeated documents and repeated items each
stand for themselves; among equal scores documents without an id come last; empty
tables give no rows. Other columns are not read, so their names can't clash.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window, functions as F, types as T

from .common import WORD_BYTES, col, slices, store, words

K = 10
OWNERS = 4
SHARD_DOCS, SHARD_BYTES = 8192, 32 << 20
BUNDLE_ITEMS, BUNDLE_TERMS = 256, 1 << 16
FILTER_BITS = 1 << 22
# Contributions of a term of weight 1 stay below this.
CEILING = 1_000_000

INDEX = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()),
    T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType())),
    T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.LongType())),
])
_INDEX = pa.schema([
    ("shard", pa.int64()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())),
])
STATE = T.StructType([
    T.StructField("owner", T.IntegerType()), T.StructField("shard", T.LongType()),
    T.StructField("items", T.ArrayType(T.IntegerType())), T.StructField("docs", T.ArrayType(T.IntegerType())),
    T.StructField("scores", T.ArrayType(T.LongType())),
])
_STATE = pa.schema([
    ("owner", pa.int32()), ("shard", pa.int64()), ("items", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())),
    ("scores", pa.list_(pa.int64())),
])
FOUND = T.StructType([
    T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()),
])
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def item_terms(items, id_col="item_id", text_col="text"):
    """A row for every item and distinct term: the item's number and id, the term, how often it stands there."""
    schema = T.StructType([
        T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[id_col].dataType),
        T.StructField("term", T.StringType()), T.StructField("repeats", T.LongType()),
    ])
    plain = items.select(
        F.monotonically_increasing_id().alias("item"), col(id_col).alias("item_id"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def count(batches):
        kind = None
        for batch in batches:
            kind = batch.schema.field("item_id").type
            for piece in slices(batch):
                rows = [
                    (n, i, t.decode(), c)
                    for n, i, x in zip(*(piece.column(k).to_pylist() for k in range(3)))
                    for t, c in Counter(words(x)).items()
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], [], []), (pa.int64(), kind, pa.string(), pa.int64()))],
                    names=["item", "item_id", "term", "repeats"],
                )

    return plain.mapInArrow(count, schema)


def term_filter(terms, bits=FILTER_BITS):
    """A bitmap of hashed terms, of one size for any number of terms."""

    def fill(batches):
        seen = np.zeros(bits, dtype=bool)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen[xxhash.xxh3_64_intdigest(t) % bits] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(bits // 8, dtype=np.uint8)
    for row in terms.select("term").mapInArrow(fill, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], dtype=np.uint8)
    return np.unpackbits(total).view(bool)


class _Shard:
    """Postings of one shard while its documents come in."""

    def __init__(self):
        self.ids, self.sizes, self.bytes, self.postings = [], [], 0, {}

    def add(self, doc_id, text, wanted):
        raw = text.encode().translate(WORD_BYTES)
        found = raw.split()
        if not found:
            return
        at = len(self.ids)
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.bytes += len(raw)
        for term, n in Counter(found).items():
            if wanted(term):
                docs, tfs = self.postings.setdefault(term, ([], []))
                docs.append(at)
                tfs.append(n)

    def full(self):
        return len(self.ids) >= SHARD_DOCS or self.bytes >= SHARD_BYTES

    def rows(self, key):
        """The directory row (no term) and a row for each term; documents are numbered in order of their ids."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        sizes = np.array(self.sizes, dtype=np.int64)
        yield key, None, None, None, sizes[order], [self.ids[k] for k in order]
        for term, (docs, tfs) in self.postings.items():
            yield key, term.decode(), place[docs], np.array(tfs, dtype=np.int64), sizes[docs], None


def index(docs, wanted, id_col="doc_id", text_col="text"):
    """Postings of all documents for the terms in the bitmap ``wanted``; nothing is shuffled.

    A shard's number is that of its task and its place in it; store the frame
    before using it twice.
    """
    bits = len(wanted)

    def cut(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        known = {}

        def hit(term):
            got = known.get(term)
            if got is None:
                if len(known) > 200_000:
                    known.clear()
                got = known[term] = bool(wanted[xxhash.xxh3_64_intdigest(term) % bits])
            return got

        def batch_of(shard, number):
            rows = list(shard.rows(base + number))
            for start in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows[start : start + 4096]), _INDEX)], schema=_INDEX
                )

        shard, number = _Shard(), 0
        for batch in batches:
            for piece in slices(batch):
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    if text:
                        shard.add(doc_id, text, hit)
                        if shard.full():
                            yield from batch_of(shard, number)
                            shard, number = _Shard(), number + 1
        if shard.ids:
            yield from batch_of(shard, number)

    plain = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(cut, INDEX)


def corpus_size(postings):
    """Documents with a term, and terms with repeats."""
    row = postings.where("term IS NULL").agg(
        F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")
    ).first()
    return row["n"] or 0, row["l"] or 0


def weigh(postings, terms, n_docs):
    """Weight of every term of the items that a document holds; exact, whatever the bitmap let through."""
    df = postings.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    ratio = F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    return df.join(terms.select("term").distinct(), "term").select(
        "term", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("weight")
    )


def owner_bounds(weighted, owners):
    """Least weights of all owners but the last, so that every owner adds about as much to the items' scores.

    Weights are whole numbers below 1000 ln(2 N + 2), so the histogram is small for any corpus.
    """
    rows = weighted.groupBy("weight").agg(F.sum("repeats").alias("n")).collect()
    by_weight = sorted(((r["weight"], r["weight"] * r["n"]) for r in rows), reverse=True)
    total, passed, bounds = sum(x for _, x in by_weight), 0, []
    for weight, share in by_weight:
        passed += share
        while len(bounds) < owners - 1 and passed * owners >= total * (len(bounds) + 1):
            bounds.append(weight)
    return bounds + [0] * (owners - 1 - len(bounds))


def _number_bundles(sizes):
    """Bundle of every item: runs of items with at most so many items and terms (one item at least)."""
    w = Window.partitionBy("slice").orderBy("item")
    return (
        sizes.withColumn("slice", F.expr("item >> 33"))
        .withColumn("terms", F.sum("n").over(w))
        .withColumn("place", F.row_number().over(w))
        .select(
            "item",
            F.struct("slice", F.floor((F.col("place") - 1) / BUNDLE_ITEMS).alias("a"), F.floor((F.col("terms") - 1) / BUNDLE_TERMS).alias("b")).alias("bundle"),
        )
    )


class _Bundle:
    """What the stages need to know of a bundle: for each owner the terms, and the items that hold them."""

    def __init__(self, rows, bounds):
        self.owners = len(bounds) + 1
        self.ids = {}
        self.by_owner = [{} for _ in range(self.owners)]
        self.rest = {}
        for number, term, repeats, weight in rows:
            at = self.ids.setdefault(number, len(self.ids))
            owner = sum(weight < b for b in bounds)
            self.by_owner[owner].setdefault(term, []).append((at, repeats * weight))
            for later in range(owner):
                self.rest[later, at] = self.rest.get((later, at), 0) + repeats * weight * CEILING


def _add(state, postings, by_term, n_items, n_docs, n_terms):
    """Dense scores of the shard's documents for every item that has any, carried ones and this owner's."""
    places = 0
    rows = []
    for term, docs, tfs, sizes in zip(*(postings.column(c) for c in ("term", "docs", "tfs", "sizes"))):
        if not term.is_valid:
            continue
        d, tf, n = (x.values.to_numpy() for x in (docs, tfs, sizes))
        m = 25 + (75 * n * n_docs) // n_terms
        rows.append((by_term[term.as_py()], d, (1_000_000_000 * tf) // (1000 * tf + 8 * m)))
        places = max(places, int(d[-1 if len(d) == 1 else d.argmax()]) + 1)
    held_items = _flat(state, "items")
    held_docs, held_scores = _flat(state, "docs"), _flat(state, "scores")
    if len(held_docs):
        places = max(places, int(held_docs.max()) + 1)
    scores = {}
    edges = np.searchsorted(held_items, np.arange(n_items + 1))
    for item in range(n_items):
        lo, hi = edges[item], edges[item + 1]
        if hi > lo:
            scores[item] = np.zeros(places, dtype=np.int64)
            scores[item][held_docs[lo:hi]] = held_scores[lo:hi]
    for users, d, part in rows:
        for item, factor in users:
            if item not in scores:
                scores[item] = np.zeros(places, dtype=np.int64)
            scores[item][d] += factor * part
    return scores


def _flat(table, name):
    c = table.column(name).combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False)


def _kth(scores, k):
    """The k-th greatest score above 0, or 0 if there are fewer."""
    if len(scores) < k:
        return 0
    return int(np.partition(scores, len(scores) - k)[len(scores) - k])


def _stage(bundle, owner, k, n_docs, n_terms):
    by_term, n_items, rest = bundle.by_owner[owner], len(bundle.ids), bundle.rest

    def run(state, postings):
        if not state.num_rows:
            return _STATE.empty_table()
        items, docs, values = [], [], []
        for item, dense in sorted(_add(state, postings, by_term, n_items, n_docs, n_terms).items()):
            at = np.flatnonzero(dense)
            got = dense[at]
            keep = got + rest.get((owner, item), 0) >= _kth(got, k)
            items.append(np.full(int(keep.sum()), item, dtype=np.int32))
            docs.append(at[keep].astype(np.int32))
            values.append(got[keep])
        one = [np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((items, np.int32), (docs, np.int32), (values, np.int64))]
        return pa.Table.from_arrays(
            [pa.array([owner + 1], pa.int32()), pa.array([state.column("shard")[0].as_py()], pa.int64())]
            + [pa.array([x], f.type) for x, f in zip(one, list(_STATE)[2:])],
            schema=_STATE,
        )

    return run


def _select(bundle, owner, k, n_docs, n_terms):
    by_term, n_items = bundle.by_owner[owner], len(bundle.ids)

    def run(state, postings):
        if not state.num_rows:
            return _FOUND.empty_table()
        ids = next(x for x in postings.column("ids") if x.is_valid).as_py()
        rows = []
        for item, dense in _add(state, postings, by_term, n_items, n_docs, n_terms).items():
            # Documents are numbered by id, so a stable sort leaves equal scores in order of ids.
            at = np.flatnonzero(dense)
            first = at[np.argsort(-dense[at], kind="stable")[:k]]
            rows += [(item, ids[d], int(dense[d])) for d in first]
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), _FOUND)], schema=_FOUND
        )

    return run


def _search_bundle(postings, bundle, k, owners, n_docs, n_terms):
    """All stages of one bundle: rows of its first k documents in each shard."""
    spark = postings.sparkSession
    owned = spark.createDataFrame(
        [(t, o) for o, terms in enumerate(bundle.by_owner) for t in terms] or [("", -1)], "term string, owner int"
    )
    # At most BUNDLE_TERMS short rows.
    mine = postings.where("term IS NOT NULL").join(F.broadcast(owned), "term")
    directory = postings.where("term IS NULL").select(F.lit(owners - 1).alias("owner"), *INDEX.names)
    mine = mine.select("owner", *INDEX.names).unionByName(directory)
    none = F.array().cast("array<int>")
    state = postings.where("term IS NULL").select(
        F.lit(0).alias("owner"), (F.col("shard") + 0).alias("shard"), none.alias("items"), none.alias("docs"), F.array().cast("array<bigint>").alias("scores")
    )
    for owner in range(owners):
        last = owner == owners - 1
        stage = (_select if last else _stage)(bundle, owner, k, n_docs, n_terms)
        state = state.groupBy("owner", "shard").cogroup(
            mine.where(F.col("owner") == owner).groupBy("owner", "shard")
        ).applyInArrow(stage, FOUND if last else STATE)
    numbers = spark.createDataFrame([(at, number) for number, at in bundle.ids.items()], "item int, number long")
    return state.join(F.broadcast(numbers), "item").select("number", "doc_id", "score")


def search(docs, items, k=K, owners=OWNERS, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text"):
    """The ``k`` highest-scoring documents of every item: item_id, rank (from 1), doc_id, score.

    Items are taken from the whole table ``items`` in bundles; every bundle passes all
    documents. What goes to tasks is a bitmap of fixed size and one bundle at a time.
    """
    terms = store(item_terms(items, item_id_col, item_text_col), "search-items")
    postings = store(index(docs, term_filter(terms), id_col, text_col), "search-postings")
    n_docs, n_terms = corpus_size(postings)
    weights = weigh(postings, terms, n_docs)
    sizes = terms.groupBy("item").agg(F.count("*").alias("n"))
    weighted = store(terms.join(weights, "term").join(_number_bundles(sizes), "item"), "search-weights")
    bounds = owner_bounds(weighted, owners)
    found = None
    for row in weighted.select("bundle").distinct().orderBy("bundle").toLocalIterator():
        b = row["bundle"]
        rows = weighted.where(
            (F.col("bundle.slice") == b["slice"]) & (F.col("bundle.a") == b["a"]) & (F.col("bundle.b") == b["b"])
        ).select("item", "term", "repeats", "weight").collect()
        part = _search_bundle(postings, _Bundle([tuple(r) for r in rows], bounds), k, owners, n_docs, n_terms)
        found = part if found is None else found.unionByName(part)
    names = terms.select(F.col("item").alias("number"), "item_id").distinct()
    if found is None:
        found = terms.sparkSession.createDataFrame([], "number long, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(names, "number").select("item_id", "rank", "doc_id", "score")
