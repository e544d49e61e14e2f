"""Encoding by a distinct-word table: equal ids, exact round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_tokens import PATH, strange
from tidemark.llm import codec, queries


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((doc, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300, "bucket_bytes": 700}])
def test_digests(spark, frame, library, options):
    rows = list(enumerate(strange(300))) + [(900, None), (901, ""), (None, "x y"), (4, "again"), (4, "again"), (902, "long " * 40000)]
    assert got(codec.digests(frame(rows).withColumn("block", F.lit(1)), PATH, **options)) == want(library, rows)


def test_encode_and_decode(spark, frame, library):
    rows = [(1, "Hello the World"), (2, None), (3, "ä\n\n 中")]
    full = codec.encode(frame(rows), PATH)
    for r in full.collect():
        text = dict(rows)[r["doc_id"]] or ""
        assert r["ids"] == library.encode(text, add_special_tokens=False).ids and r["decoded"] == text
    back = {r["doc_id"]: r["decoded"] for r in codec.decode(full, PATH).collect()}
    assert back == {1: "Hello the World", 2: "", 3: "ä\n\n 中"}


def test_empty_table(spark, frame):
    assert codec.digests(frame([]), PATH).count() == 0


def test_given_table(spark, data, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got(queries.op10_bpe(spark, data)) == want(library, rows)


def test_blocks_are_moved_once(spark, data):
    df = queries.op10_bpe(spark, data)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
