"""Exact token counts by rank-synchronous merging of ragged arrays."""

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from .bpe import Encoder, Model, split_pieces
from .common import slices, texts

LIMIT = 512
MEMO = 500_000

_COUNTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
])


def count_tokens(docs, tokenizer_path, id_col="doc_id", text_col="text", limit=LIMIT, memo=MEMO):
    """UTF-8 bytes, tokens and whether they exceed ``limit``, for every row.

    ``tokenizer_path`` is a byte-level BPE file, read on the driver and sent out
    (its size is that of a vocabulary). Special strings inside a text count as
    their one token. Null and empty texts have no tokens; repeated rows are
    counted alike; an id may be null. A task keeps the counts of up to ``memo``
    pieces and starts anew beyond that, which changes no result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Model.load(tokenizer_path))

    def count(batches):
        encoder, first, later = Encoder(sent.value), {}, {}

        def learn(known, wanted, lead):
            if len(known) > memo:
                known.clear()
            new = list(wanted - known.keys())
            known.update(zip(new, encoder.encode([lead + p for p in new])[1].tolist()))

        for batch in batches:
            for piece in slices(batch):
                ids, values = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                cut = [split_pieces(t) for t in values]
                heads, wanted = {c[0] for c in cut if c}, set()
                for c in cut:
                    wanted.update(c[1:])
                if len(first) > memo or len(later) > memo:
                    first, later = {}, {}
                learn(first, heads, "")
                learn(later, wanted, " ")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()),
                    "n_bytes": pa.array([len(t.encode()) for t in values], pa.int64()),
                    "n_tokens": pa.array([first[c[0]] + sum(map(later.__getitem__, c[1:])) if c else 0 for c in cut], pa.int64()),
                })

    counted = texts(docs, id_col, text_col).mapInArrow(count, _COUNTS)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
