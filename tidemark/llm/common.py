"""Helpers shared by the operators: input columns, small stored tables, ragged arrays."""

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from ..session import scratch

# Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words(text):
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z, as UTF-8."""
    return text.encode().translate(WORD_BYTES).split()


def tokens(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text after lower-casing A-Z, as UTF-8."""
    return text.encode().lower().split()


def col(name):
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df, *names):
    """The names, with underscores added until no column of the frame is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def texts(docs, id_col="doc_id", text_col="text"):
    """Only the id and the text (null: empty), so that other columns can never clash."""
    return docs.select(
        col(id_col).cast("long").alias("doc_id"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )


CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df, name, once=False):
    """Write a frame to the folder all executors share and read it back.

    Later steps then start from stored rows, also after executors are lost. With ``once``
    nothing else reads what was shuffled for it, and that goes when the rows are stored.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    old = spark.conf.get(CLEANUP_CONF, None)
    if once:
        spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        if once:
            spark.conf.unset(CLEANUP_CONF) if old is None else spark.conf.set(CLEANUP_CONF, old)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs):
    """Bytes of all texts of a frame made by ``texts``, and its rows."""
    row = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    return row["b"] or 0, row["n"]


def parts(total, each, least=1):
    return max(least, math.ceil(total / each))


def slices(batch, limit=4 << 20, column="text"):
    """Cut an Arrow batch into runs of rows of about ``limit`` bytes of text (one row at least)."""
    sizes = np.diff(np.asarray(_offsets(batch.column(batch.schema.get_field_index(column)))))
    start = 0
    ends = np.cumsum(sizes)
    n = batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _offsets(array):
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1]


def ragged_gather(flat, starts, lengths, chosen):
    """The elements of the chosen runs of ``flat``, one run after the other, and where each ends."""
    n = lengths[chosen]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(starts[chosen] - (ends - n), n)
    return flat[at], ends


def squeeze(data):
    return zstandard.ZstdCompressor(level=3).compress(bytes(data))


def unsqueeze(data):
    return zstandard.ZstdDecompressor().decompress(data)


def planes(numbers):
    """Compress unsigned integers; bytes of one weight stand together."""
    a = np.ascontiguousarray(numbers, dtype=np.uint64).view(np.uint8).reshape(-1, 8).T
    return squeeze(a.tobytes())


def unplanes(data):
    a = np.frombuffer(unsqueeze(data), dtype=np.uint8).reshape(8, -1).T
    return np.ascontiguousarray(a).view(np.uint64).ravel()
