"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes weighted counts of hashed features: words, pairs of neighbouring byte
classes, and how much is repeated. A truncated SVD over a bounded sample of labelled
texts turns these into latent-semantic vectors. The sample's vectors are broadcast;
every document's cosines with all of them are computed in blocks, and the nearest
vote with their similarity.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from .common import col, slices, texts, words

#: Labelled rows that the classifier is fitted on, half of them of each label if there are enough.
SAMPLE = 4000
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8
BLOCK = 512

_WORDS, _CLASSES, _SHARES = 512, 16, 8
FEATURES = _WORDS + _CLASSES * _CLASSES + _SHARES * 4


def _byte_classes():
    """A class for each byte: letters by case, digits, white space, kinds of signs, upper bytes."""
    out = np.full(256, 15, dtype=np.uint8)
    out[97:123], out[65:91], out[48:58], out[128:192], out[192:256] = 0, 1, 2, 3, 4
    for number, signs in enumerate((" ", "\n\r\t", ".", ",", "!?", ";:'\"", "()[]{}", "|", "*#%&$", "@/\\"), start=5):
        out[list(signs.encode())] = number
    return out


_CLASS = _byte_classes()
_LINE = re.compile(r"[^\n]+")


def _share(row, at, value):
    """A share from 0 to 1 as a soft step over ``_SHARES`` features."""
    place = min(max(value, 0.0), 1.0) * (_SHARES - 1)
    low = int(place)
    row[at + low] += 1 - (place - low)
    if low + 1 < _SHARES:
        row[at + low + 1] += place - low


def features(text):
    """The feature counts of a text; all zero if it has no bytes."""
    row = np.zeros(FEATURES, dtype=np.float32)
    data = text.encode()
    if not data:
        return row
    kind = _CLASS[np.frombuffer(data, dtype=np.uint8)].astype(np.int64)
    row[_WORDS : _WORDS + _CLASSES**2] = np.bincount(kind[:-1] * _CLASSES + kind[1:], minlength=_CLASSES**2)
    w = words(text)
    at = _WORDS + _CLASSES**2
    if w:
        row[:_WORDS] = np.bincount(np.fromiter(map(zlib.crc32, w), np.int64, len(w)) % _WORDS, minlength=_WORDS)
        _share(row, at, len(set(w)) / len(w))
        _share(row, at + _SHARES, sum(a == b for a, b in zip(w, w[1:])) / len(w))
        _share(row, at + 2 * _SHARES, sum(map(len, w)) / len(w) / 16)
    lines = _LINE.findall(text)
    _share(row, at + 3 * _SHARES, len(set(lines)) / max(1, len(lines)))
    row[:at] = np.log1p(row[:at])
    row[at:] *= 3
    return row


class Voter:
    """Fitted weights, the projection, and the labelled vectors that vote."""

    def __init__(self, rows, labels, prior, votes=(1.0, 1.0), dimensions=DIMENSIONS, neighbours=NEIGHBOURS):
        self.prior = prior
        self.labels = np.asarray(labels, dtype=np.float32)
        #: The weight of each row's vote, from that of its label.
        self.votes = np.asarray(votes, dtype=np.float64)[self.labels.astype(np.int64)]
        self.neighbours = min(neighbours, len(labels))
        if len(labels):
            rows = np.asarray(rows, dtype=np.float32)
            self.weight = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + 1
            _, _, axes = np.linalg.svd(self._scaled(rows), full_matrices=False)
            self.axes = np.ascontiguousarray(axes[:dimensions].T)
            self.vectors = self.project(rows)

    def _scaled(self, rows):
        out = rows * self.weight
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def project(self, rows):
        out = self._scaled(rows) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, rows):
        """Share of label 1 among the nearest, by similarity and vote; the prior where nothing is near."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        out = []
        for start in range(0, len(rows), BLOCK):
            near = self.project(rows[start : start + BLOCK]) @ self.vectors.T
            top = np.argpartition(-near, self.neighbours - 1, axis=1)[:, : self.neighbours]
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** SHARPNESS
            weight *= self.votes[top]
            out.append(((weight * self.labels[top]).sum(axis=1) + 0.01 * self.prior) / (weight.sum(axis=1) + 0.01))
        return np.concatenate(out)


def _featured(rows):
    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                values = [features(t).tobytes() for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(values, pa.binary())], names=["doc_id", "row"])

    return rows.mapInArrow(run, "doc_id long, row binary")


def held_out(modulus=3, remainder=1):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def fit(docs, labels, id_col="doc_id", text_col="text", label_col="quality", sample=SAMPLE, modulus=3, remainder=1, **options):
    """A voter fitted on at most ``sample`` labelled rows that are not held out.

    The rows are those of the least hashed ids, of each label up to half the sample.
    A row's vote weighs its label's share in all training rows over that in the sample,
    so scores mean the same below and above the bound.
    Labels of an id that repeats are averaged, null ids and labels are left out, of
    several texts of an id the one of the least features counts. Only the sample's
    features reach the driver.
    """
    known = labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("double").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out(modulus, remainder))
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    shares = known.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    prior = (shares["ones"] or 0) / shares["n"] if shares["n"] else 0.5
    # How many are known and chosen of each label.
    of = np.array([(shares["n"] or 0) - (shares["ones"] or 0), shares["ones"] or 0], dtype=np.float64)
    taken = np.minimum(of, sample // 2)
    votes = of * taken.sum() / np.maximum(1, taken * of.sum())
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most ``sample`` ids and numbers.
    picked = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    rows = (
        _featured(picked.select("doc_id", "text")).groupBy("doc_id").agg(F.min("row").alias("row"))
        .join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()
    )
    data = np.array([np.frombuffer(bytes(r["row"]), dtype=np.float32) for r in rows]).reshape(len(rows), FEATURES)
    return Voter(data, [r["label"] for r in rows], prior, votes, **options)


def classify(docs, voter, id_col="doc_id", text_col="text"):
    """Score and predicted label of every row.

    A null or empty text has no neighbours and gets the share of label 1 among the
    training rows; without any labelled rows each score is 0.5. Equal texts get
    equal scores; ids may be null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(voter)

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                rows = np.array([features(t) for t in piece.column(1).to_pylist()]).reshape(piece.num_rows, FEATURES)
                score = sent.value.score(rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs, voter, text_col="text"):
    """The rows whose text is predicted to be good, with all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(voter)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, column=text_col):
                rows = np.array([features(t or "") for t in piece.column(place).to_pylist()]).reshape(piece.num_rows, FEATURES)
                yield piece.filter(pa.array(sent.value.score(rows) >= 0.5))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
