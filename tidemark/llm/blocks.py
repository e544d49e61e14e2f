"""Blocks of documents that ask hashed buckets about their keys.

A vocabulary or an n-gram table grows with the corpus, so it is neither sent to
every task nor joined row by row. Documents stand in blocks of a few megabytes;
a block asks each bucket once about its own distinct keys, a bucket answers all
blocks, and the answers meet the block again by its id. A key that is in every
document is asked for once a block, so no key is hot.
"""

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import types as T

from ..session import scratch
from .common import slices, squeeze, texts, unsqueeze

BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("blob", T.BinaryType())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


def pack(rows):
    """Documents as compressed Arrow, and an id made of all they hold."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _DOCS) as out:
        out.write_batch(pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.large_string())],
            schema=_DOCS,
        ))
    raw = sink.getvalue().to_pybytes()
    return raw, squeeze(raw)


def unpack(blob):
    with pa.ipc.open_stream(unsqueeze(blob)) as source:
        table = source.read_all()
    return table.column(0).to_pylist(), table.column(1).to_pylist()


def make_blocks(docs, id_col="doc_id", text_col="text", block_bytes=8 << 20):
    """One row for each block: id and compressed documents.

    The id is a hash of the content and of the place in the partition, so a
    task that runs again gives the same blocks.
    """

    def cut(batches):
        from pyspark import TaskContext

        held, size, number = [], 0, 0
        part = TaskContext.get().partitionId()

        def full():
            nonlocal held, size, number
            raw, blob = pack(held)
            key = xxhash.xxh3_64_intdigest(raw, seed=part * 1_000_003 + number) >> 1
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([blob], pa.binary())], names=["block", "blob"]
            )

        for batch in batches:
            for piece in slices(batch, block_bytes):
                ids, values = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                for row in zip(ids, values):
                    held.append(row)
                    size += len(row[1])
                    if size >= block_bytes:
                        yield full()
        if held:
            yield full()

    return texts(docs, id_col, text_col).mapInArrow(cut, BLOCK)


def store_by_block(blocks, files):
    """Blocks written to the shared folder in ``files`` buckets by their id, and read back.

    What is grouped or cogrouped by the id then reads the blocks where they lie; only the
    other side is shuffled to them.
    """
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(files, "block").option("path", scratch(spark, "blocks")).saveAsTable(name)
    kept = spark.table(name)
    # The frame knows its files; the name is not needed any more, and dropping it leaves them.
    spark.sql(f"DROP TABLE {name}")
    return kept


def by_bucket(hashes, buckets):
    """Order of hashed keys by bucket and key, and the bounds of each bucket in it."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))
