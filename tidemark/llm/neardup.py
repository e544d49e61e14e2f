"""Near-duplicate groups by one-permutation MinHash with optimal densification.

A document's word shingles are hashed once; the least hash of each of ``bins``
ranges is its signature, and an empty bin borrows from the first filled bin of an
order of its own. Bands of ``rows`` bins make bucket keys.

Documents of equal shingle sets are one class. In a bucket a star links all
classes to one centre, the class that meets most others; links are confirmed on
whole sets, and components grow. Buckets that then still hold more than one
component get the pairs across components that no star has joined, so no link
between components is lost to the star shape.

A class also carries the parity of its shingles in 1024 cells. Cells that differ
between two classes are a lower bound of their sets' difference, so pairs that
surely are not alike are never made.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F, types as T

from .common import col, parts, slices, squeeze, store, texts, tokens, unsqueeze
from .components import components

BANDS, ROWS = 42, 6
STAR_ROUNDS = 1
CELLS = 1024
CENTRE_MEMBERS = 500
# A bucket is cut in parts of so many members, so that no task makes more than their square of pairs.
PART_MEMBERS = 8192

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(a):
    a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    a = (a ^ (a >> np.uint64(29))) * _MIX
    return a ^ (a >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; hashes of words are remembered."""

    def __init__(self, size, memo=100_000):
        self.size, self.limit, self.known = size, memo, {}

    def __call__(self, text):
        w = tokens(text)
        if not w:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for x in set(w).difference(known):
            known[x] = xxhash.xxh3_64_intdigest(x)
        h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        n = max(1, len(h) - self.size + 1)
        # The number of words takes part, so that a short sequence is no shingle of another length.
        out = np.full(n, min(self.size, len(h)), dtype=np.uint64)
        for k in range(min(self.size, len(h))):
            out = _mix(out * _MIX + h[k : k + n])
        return np.unique(out)


class Signer:
    """Band keys of a set of shingles."""

    def __init__(self, bands=BANDS, rows=ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        # borrow[i]: the place of every bin in the order in which empty bin i asks.
        self.borrow = np.argsort(np.random.default_rng(17).random((self.bins, self.bins)), axis=1).argsort(axis=1).astype(np.int16)
        self.edges = np.array([(k << 64) // self.bins + (k > 0) for k in range(self.bins)], dtype=object).astype(np.uint64)

    def __call__(self, shingles):
        at = np.searchsorted(shingles, self.edges)
        value = shingles[np.minimum(at, len(shingles) - 1)]
        filled = at < np.append(at[1:], len(shingles))
        have = np.flatnonzero(filled)
        gaps = np.flatnonzero(~filled)
        if len(gaps):
            value[gaps] = value[have[self.borrow[np.ix_(gaps, have)].argmin(axis=1)]]
        grid = value.reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * _MIX
        for k in range(self.rows):
            key = _mix(key * _MIX + grid[:, k])
        return key.view(np.int64)


_SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType())),
])
_PACKED = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("packed", T.BinaryType())])


def _digest(shingles):
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else b""


def _parity(shingles):
    cell = (shingles & np.uint64(CELLS - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=CELLS) & 1).view(np.int64)


def signatures(docs, size, bands, rows):
    """Set size, set digest, band keys and parities of each row of ``texts``; further columns are kept."""
    more = docs.columns[2:]

    def sign(batches):
        shingle, signer = Shingler(size), Signer(bands, rows)
        for batch in batches:
            for piece in slices(batch, 1 << 20):
                sets = [shingle(t) for t in piece.column(1).to_pylist()]
                keys = [signer(s) if len(s) else np.zeros(0, dtype=np.int64) for s in sets]
                offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys), pa.int64())),
                    pa.array([_parity(s) for s in sets], pa.list_(pa.int64())), *piece.columns[2:],
                ], names=[*_SIGNED.names, *more])

    return docs.mapInArrow(sign, T.StructType([*_SIGNED.fields, *(docs.schema[c] for c in more)]))


def _packed(docs, wanted, size):
    """Compressed text for each wanted set digest; it is smaller than the set it stands for."""

    def squeezed(batches):
        for batch in batches:
            values = pa.array([squeeze(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "packed"])

    def checked(batches):
        # Rows of one id may hold other texts than the wanted one.
        shingle = Shingler(size)
        for batch in batches:
            same = [_digest(shingle(unsqueeze(p).decode())) == n for n, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_()))

    small = docs.where("doc_id IS NOT NULL").mapInArrow(squeezed, "doc_id long, packed binary")
    found = small.join(wanted, "doc_id").select("node", "packed").mapInArrow(checked, _PACKED)
    return found.groupBy("node").agg(F.first("packed").alias("packed"))


def confirm(pairs, packed, size, percent):
    """Of the pairs (a, b) those whose whole sets are alike enough.

    Every pair travels with the text of ``b`` to its centre ``a``. A centre of many
    pairs is copied to several places, so that each task sees a bounded part.
    """
    places = pairs.groupBy("a").agg(F.count("*").alias("n")).select(
        "a", F.ceil(F.col("n") / CENTRE_MEMBERS).cast("int").alias("places"))
    place = F.pmod(F.xxhash64("b"), F.col("places")).cast("int")
    member = (
        pairs.join(places, "a").select("a", "b", place.alias("place"))
        .join(packed.select(F.col("node").alias("b"), "packed"), "b")
        .select("a", "place", "b", "packed")
    )
    centre = (
        places.join(packed.select(F.col("node").alias("a"), "packed"), "a")
        .select("a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(None).cast("binary").alias("b"), "packed")
    )
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def compare(batches):
        shingle, now, own = Shingler(size), None, None
        for batch in batches:
            a, place, b = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for k in range(batch.num_rows):
                other = shingle(unsqueeze(batch.column(3)[k].as_py()).decode())
                if b[k] is None:
                    now, own = (a[k], place[k]), other
                    continue
                assert now == (a[k], place[k])
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    out.append((a[k], b[k]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return (
        member.unionByName(centre).repartition("a", "place")
        .sortWithinPartitions("a", "place", F.col("b").asc_nulls_first())
        .mapInArrow(compare, schema)
    )


def _grow(known, links):
    """Components of classes after new links; ``known`` may be None."""
    pairs = links
    if known is not None:
        of = lambda side: known.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        pairs = (
            links.join(of("a"), "a", "left").join(of("b"), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        )
    new = store(components(pairs), "components")
    if known is None:
        return new
    moved = new.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return store(old.unionByName(new.join(known.select("node"), "node", "left_anti")), "components")


def _in_parts(rest):
    """Rows of each bucket with a part of it (``part``) and into how many it is cut (``cut``)."""
    cut = rest.groupBy("key").agg(F.ceil(F.count("*") / PART_MEMBERS).cast("int").alias("cut"))
    return rest.join(cut, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))


def groups(docs, id_col="doc_id", text_col="text", size=3, percent=85, bands=BANDS, rows=ROWS, star_rounds=STAR_ROUNDS, keyed=False):
    """Set size, component and whether the row is kept, for every row.

    Linked are documents whose sets of ``size``-word shingles have a Jaccard
    likeness of at least ``percent`` hundredths; a text of fewer words is one
    shingle. With the default bands a pair just at 85 is missed with a chance of
    6e-9, one at 80 with 3e-6. The component is the least id that links reach.

    Null and empty texts have no shingles and stay alone. A row without an id is
    kept and has no component. Rows of one id count as documents of their own that
    share the id; each is returned. ``keyed`` adds ``text_key`` (SHA-256 of the text) and
    ``group``, which tells components apart even if ids repeat (null: no shingles or no id).
    """
    named = texts(docs, id_col, text_col)
    if keyed:
        named = named.withColumn("text_key", F.sha2("text", 256))
    signed = store(signatures(named, size, bands, rows), "signatures")
    # One class for all documents of a set, named by the set's digest.
    classes = store(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("digest").alias("node"))
        .agg(F.min(F.struct("doc_id", "n_shingles", "bands", "parity")).alias("r"))
        .select("node", "r.doc_id", F.col("r.n_shingles").alias("n"), "r.bands", "r.parity"),
        "classes",
    )
    entries = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    members = store(entries.join(shared, "key").select("key", "node", "n", "times"), "members")
    # How many others a class meets, the same in all of its buckets.
    met = members.groupBy("node").agg(F.sum("times").alias("met"))
    members = store(members.drop("times").join(met, "node"), "members")
    wanted = members.select("node").distinct().join(classes.select("node", "doc_id"), "node")
    packed = store(_packed(named, wanted, size), "packed")
    known = None
    both = F.col("na") + F.col("nb")
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    apart = sum((F.bit_count(F.get("pa", F.lit(k)).bitwiseXOR(F.get("pb", F.lit(k)))) for k in range(CELLS // 64)), F.lit(0))
    near = 100 * (both - apart) >= percent * (both + apart)
    side = lambda x: [F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}")]
    for turn in range(star_rounds + 1):
        at = members
        if known is not None:
            at = at.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        else:
            at = at.withColumn("component", F.col("node"))
        open_ = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.struct("met", "node")).alias("c"))
        open_ = open_.where("lo < hi").select("key", F.col("c.node").alias("centre"))
        rest = at.join(open_, "key")
        if turn < star_rounds:
            rest = store(rest, "rest")
            first = rest.where("node = centre").select("key", *side("a"))
            pairs = first.join(rest.select("key", *side("b")), "key").where((F.col("ca") != F.col("cb")) & sized)
        else:
            rest = store(_in_parts(rest.join(classes.select("node", "parity"), "node")), "rest")
            every = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
            first, other = (
                rest.select("key", *side(x), F.col("parity").alias(f"p{x}"), mine.alias("left_part"), theirs.alias("right_part"))
                for x, mine, theirs in (("a", F.col("part"), every), ("b", every, F.col("part")))
            )
            pairs = first.join(other, ["key", "left_part", "right_part"]).where((F.col("ca") < F.col("cb")) & sized & near)
        pairs = store(pairs.select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            continue
        links = store(confirm(pairs, packed, size, percent), "confirmed")
        if not links.isEmpty():
            known = _grow(known, links)
    of = classes.select("node", "doc_id")
    if known is not None:
        of = of.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = of.groupBy("component").agg(F.min("doc_id").alias("least"))
        of = of.join(least, "component").select("node", "least", "component")
    else:
        of = of.select("node", F.col("doc_id").alias("least"), F.col("node").alias("component"))
    more = ["text_key", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("group")] if keyed else []
    out = signed.select("doc_id", "n_shingles", F.col("digest").alias("node"), *(["text_key"] if keyed else [])).join(of, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), *more).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs, id_col="doc_id", text_col="text", size=5, percent=80, **options):
    """The documents that stand for their group, one row each, with all columns as they are.

    The row of the least id stays, of several texts of that id in one group that of the
    least SHA-256. Rows that repeat an id and its text are one document, and the row whose
    other columns are least as JSON stays. Rows without an id stay, and so does the text
    without words of each id. Unlike texts under one id are documents of their own.
    """
    found = groups(docs, id_col, text_col, size, percent, keyed=True, **options).where("doc_id IS NOT NULL AND kept")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    keep = found.where(F.col("group").isNotNull()).groupBy("group").agg(first).select("first.*")
    keep = keep.unionByName(found.where(F.col("group").isNull()).select("doc_id", "text_key").distinct())
    # A row travels as one struct, so no column of it can clash.
    key, others = col(id_col).cast("long"), [col(c) for c in docs.columns if c != text_col]
    rows = docs.select(
        key.alias("doc_id"), F.sha2(F.coalesce(col(text_col).cast("string"), F.lit("")), 256).alias("text_key"),
        F.struct(*map(col, docs.columns)).alias("row"), F.to_json(F.struct(*others)).alias("rank"),
    )
    one = rows.join(keep, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.min_by("row", "rank").alias("row")).select("row.*")
    return one.unionByName(docs.where(key.isNull()))
