"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes decides where a text is cut; before the normal
size a harder condition holds than after it, so that sizes stay close. The set of
chunk digests, each weighted by its chunk's length, is the fingerprint. Text that
moves keeps its cuts, so containment of sets measures shared content.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from .common import parts, slices, squeeze, text_bytes, texts, unsqueeze

SMALLEST, NORMAL, LARGEST = 16, 48, 192
HARD_BITS, EASY_BITS = 7, 4
PART_BYTES = 16 << 20

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data):
    """Ends of the chunks of some bytes."""
    n = len(data)
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for m in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[m:] += h[:-m] << np.uint32(m)
        h = wider
    easy = np.flatnonzero(h >> np.uint32(32 - EASY_BITS) == 0)
    hard = (h[easy] >> np.uint32(32 - HARD_BITS) == 0).tolist()
    easy = (easy + 1).tolist()
    out, start, k, last = [], 0, 0, len(easy)
    while start < n:
        cut = min(start + LARGEST, n)
        least, normal = start + SMALLEST, start + NORMAL
        while k < last and easy[k] < least:
            k += 1
        j = k
        while j < last and easy[j] < cut:
            if hard[j] or easy[j] >= normal:
                cut = easy[j]
                break
            j += 1
        out.append(cut)
        start, k = cut, j
    return out


def chunks(text):
    """Digest and length of each distinct chunk of a text."""
    data = text.encode()
    out, start = {}, 0
    for end in cuts(data):
        piece = data[start:end]
        out[hashlib.blake2b(piece, digest_size=8).hexdigest()] = end - start
        start = end
    return out


def written(found):
    """A fingerprint as text: digest:length, sorted."""
    return ",".join(f"{d}:{n}" for d, n in sorted(found.items()))


def containment(a, b):
    """Share of a's content, by length, that b holds too; 1 for two empty sets, 0 for one."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprints(docs, id_col="doc_id", text_col="text"):
    """Fingerprint of every row; a null or empty text has the empty one."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                values = [written(chunks(t)) for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(values, pa.string())], names=["doc_id", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


COMPARED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])
_MOVED = T.StructType([
    T.StructField("bucket", T.LongType()), T.StructField("copy", T.BooleanType()), T.StructField("key", T.LongType()),
    T.StructField("named", T.BooleanType()), T.StructField("tie", T.BinaryType()), T.StructField("packed", T.BinaryType()),
])
_NO_ID = -(2**63)


def _highest(batches):
    """The highest key of a range partition, if it has any."""
    top = None
    for batch in batches:
        if batch.num_rows:
            most = max(batch.column(0).to_pylist())
            top = most if top is None else max(top, most)
    if top is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([top], pa.int64())})


def _edited(text, following):
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_with_next(docs, id_col="doc_id", text_col="text", part_bytes=PART_BYTES):
    """Fingerprints of each row's text and of its edited text, and how alike they are.

    The next row is that of the next lower id, after the last one the first; rows of
    one id follow each other by the digest of their texts, rows without an id
    stand last. The last third of a text's code points is replaced by as many of
    the next row's first ones (or all it has). ``near_edited`` and ``near_next`` are
    the share of the row's own fingerprint that the other one holds. Null texts
    are empty; a single row follows itself.

    Rows move once, compressed, to ranges of ids; of each range the head is also
    sent to the range before it, so no neighbour is missed.
    """
    rows = texts(docs, id_col, text_col)
    total, _ = text_bytes(rows)
    ranges = parts(total, part_bytes)
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    # One number for each range reaches the driver: the highest id in it.
    heads = rows.select(key.alias("key")).repartitionByRange(ranges, "key").mapInArrow(_highest, "key long").collect()
    heads = np.array(sorted(r["key"] for r in heads), dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(heads)

    def move(batches):
        tops = sent.value
        for batch in batches:
            for piece in slices(batch):
                out = []
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    data = text.encode()
                    own = _NO_ID if doc is None else doc
                    # The number of a range from the highest ids down.
                    at = len(tops) - 1 - int(np.searchsorted(tops, own))
                    row = (own, doc is not None, hashlib.blake2b(data, digest_size=16).digest(), squeeze(data))
                    out.append((at, False, *row))
                    if own == tops[len(tops) - 1 - at]:
                        out.append(((at - 1) % len(tops), True, *row))
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=_MOVED.names)

    def compare(batches):
        held = None
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for i, (bucket, copy, own, named, _) in enumerate(zip(*columns)):
                if copy and (held is None or held[0] != bucket):
                    continue
                text = unsqueeze(batch.column(5)[i].as_py()).decode()
                now = (bucket, own if named else None, text, chunks(text))
                if held is not None:
                    _, doc, before, print_ = held
                    edited = _edited(before, text)
                    other = chunks(edited)
                    out.append((
                        doc, len(before), hashlib.sha256(edited.encode()).hexdigest(), written(print_), written(other),
                        containment(print_, other), containment(print_, now[3]),
                    ))
                # After a head that was sent here, the range is done.
                held = None if copy else now
            kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=COMPARED.names)

    return (
        rows.mapInArrow(move, _MOVED).repartition(ranges, "bucket")
        .sortWithinPartitions("bucket", "copy", F.desc("key"), "tie").mapInArrow(compare, COMPARED)
    )
