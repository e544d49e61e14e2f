"""BPE ids of whole corpora by a table of distinct words, and back by an id-to-piece look-up.

Texts are split to words (pieces that no token crosses). Each block of documents
asks the hashed word buckets about its distinct words; a bucket encodes a distinct
word once for the whole corpus and answers every block that holds it. A block puts
the ids back by the word's position. Decoding looks ids up in the broadcast vocabulary,
whose size is fixed by the tokenizer's file.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import types as T

from .blocks import by_bucket, make_blocks, unpack
from .bpe import Encoder, Model, split_pieces
from .common import parts, planes, ragged_gather, squeeze, text_bytes, texts, unplanes, unsqueeze

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
# Blocks whose ids and texts are given out whole take about three times their text more than their digests do.
FULL_BLOCK_BYTES = 4 << 20
ENCODE_WORDS = 100_000

_ASK = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("words", T.BinaryType()),
])
_ANSWER = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType()),
])
ENCODED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.StringType()),
])
DIGESTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])


def _word_table(values):
    """Distinct words of some texts in order of appearance, and each text's word numbers."""
    number, each = {}, []
    for text in values:
        cut = split_pieces(text)
        # A word inside a text has a blank before it; the first one has none.
        each.append([number.setdefault(w, len(number)) for w in ([cut[0], *(" " + p for p in cut[1:])] if cut else ())])
    return list(number), each


def _hashes(distinct):
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in distinct), np.uint64, len(distinct))


def _pack_words(chosen):
    data = [w.encode() for w in chosen]
    sizes = np.fromiter(map(len, data), np.uint32, len(data)).tobytes()
    return squeeze(len(data).to_bytes(4, "little") + sizes + b"".join(data))


def _unpack_words(blob):
    data = unsqueeze(blob)
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4).astype(np.int64)) + 4 + 4 * n
    starts = np.concatenate(([4 + 4 * n], ends[:-1])) if n else ends
    return [data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]


def _ask(buckets):
    def ask(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                distinct, _ = _word_table(unpack(blob.as_py())[1])
                order, bounds = by_bucket(_hashes(distinct), buckets)
                rows = [(b, _pack_words([distinct[k] for k in order[bounds[b] : bounds[b + 1]]])) for b in range(buckets) if bounds[b] < bounds[b + 1]]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([r[0] for r in rows], pa.int32()),
                    "block": pa.array([block] * len(rows), pa.int64()),
                    "words": pa.array([r[1] for r in rows], pa.binary()),
                })

    return ask


def _answer(model):
    def answer(table):
        """All blocks' words of one bucket: encode each distinct word once, answer in the asked order."""
        encoder = Encoder(model.value)
        bucket = table.column("bucket")[0].as_py()
        asked = [_unpack_words(w.as_py()) for w in table.column("words")]
        number = {}
        for some in asked:
            for w in some:
                number.setdefault(w, len(number))
        distinct = list(number)
        flats, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for start in range(0, len(distinct), ENCODE_WORDS):
            flat, n = encoder.encode(distinct[start : start + ENCODE_WORDS])
            flats.append(flat)
            sizes.append(n)
        flat, size = np.concatenate(flats), np.concatenate(sizes)
        starts = np.cumsum(size) - size
        blobs = []
        for some in asked:
            chosen = np.fromiter(map(number.__getitem__, some), np.int64, len(some))
            ids, _ = ragged_gather(flat, starts, size, chosen)
            lengths = planes(size[chosen])
            blobs.append(len(lengths).to_bytes(4, "little") + lengths + planes(ids))
        return pa.table({
            "block": table.column("block"), "bucket": pa.array([bucket] * len(blobs), pa.int32()),
            "blob": pa.array(blobs, pa.binary()),
        })

    return answer


def _assemble(model, buckets, full):
    def assemble(docs, answers):
        """Ids of each document of a block, and its text again from the pieces of the ids."""
        pieces = model.value.pieces
        piece_size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece_start = np.cumsum(piece_size) - piece_size
        letters = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        answer = dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()))
        out = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for blob in docs.column("blob").to_pylist():
            doc_ids, values = unpack(blob)
            distinct, each = _word_table(values)
            order, bounds = by_bucket(_hashes(distinct), buckets)
            size, found = np.zeros(len(distinct), dtype=np.int64), []
            for b in range(buckets):
                if bounds[b] < bounds[b + 1]:
                    data = answer[b]
                    cut = 4 + int.from_bytes(data[:4], "little")
                    size[order[bounds[b] : bounds[b + 1]]] = unplanes(data[4:cut])
                    found.append(unplanes(data[cut:]).astype(np.int64))
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            starts = np.zeros(len(distinct), dtype=np.int64)
            starts[order] = np.cumsum(size[order]) - size[order]
            for doc, word_numbers in zip(doc_ids, each):
                ids, _ = ragged_gather(flat, starts, size, np.array(word_numbers, dtype=np.int64))
                data, _ = ragged_gather(letters, piece_start, piece_size, ids)
                decoded = data.tobytes().decode("utf-8", "replace")
                out["doc_id"].append(doc)
                if full:
                    out["ids"].append(ids.astype(np.int32))
                    out["decoded"].append(decoded)
                else:
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        schema = ENCODED if full else DIGESTS
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        return pa.table({f: pa.array(out[f], kinds.get(f, pa.string())) for f in schema.names})

    return assemble


def _run(docs, tokenizer_path, id_col, text_col, block_bytes, bucket_bytes, full):
    model = docs.sparkSession.sparkContext.broadcast(Model.load(tokenizer_path))
    total, _ = text_bytes(texts(docs, id_col, text_col))
    buckets, spread = parts(total, bucket_bytes), parts(total, block_bytes)
    # One exchange of the compressed blocks serves both the questions and the answers.
    blocks = make_blocks(docs, id_col, text_col, block_bytes).repartition(spread, "block")
    asked = blocks.mapInArrow(_ask(buckets), _ASK)
    answers = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer(model), _ANSWER)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _assemble(model, buckets, full), ENCODED if full else DIGESTS)


def encode(docs, tokenizer_path, id_col="doc_id", text_col="text", block_bytes=FULL_BLOCK_BYTES, bucket_bytes=BUCKET_BYTES):
    """Token ids of every row, and the text that they decode to.

    ``tokenizer_path`` is a byte-level BPE file; no tokens are added, special strings
    in a text become their token, bytes that are no UTF-8 decode to the replacement
    character. Null and empty texts have no ids; an id may be null; repeated rows
    are encoded alike. A text of any length is one document of one block.
    """
    return _run(docs, tokenizer_path, id_col, text_col, block_bytes, bucket_bytes, True)


def digests(docs, tokenizer_path, id_col="doc_id", text_col="text", block_bytes=BLOCK_BYTES, bucket_bytes=BUCKET_BYTES):
    """Number and digests of the ids and the decoded text that ``encode`` gives, without moving them."""
    return _run(docs, tokenizer_path, id_col, text_col, block_bytes, bucket_bytes, False)


def decode(encoded, tokenizer_path, id_col="doc_id", ids_col="ids"):
    """Text of arrays of ids, by a look-up in the broadcast vocabulary; null arrays stay null."""
    model = encoded.sparkSession.sparkContext.broadcast(Model.load(tokenizer_path))
    rows = encoded.select(id_col, ids_col)
    kind = T.StructType([rows.schema[id_col], T.StructField("decoded", T.StringType())])

    def back(batches):
        pieces = model.value.pieces
        for batch in batches:
            texts_ = [None if x is None else b"".join(map(pieces.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_, pa.string())], names=kind.names)

    return rows.mapInArrow(back, kind)
