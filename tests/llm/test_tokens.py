"""Merging of ragged arrays against the library that defines the tokens."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import queries, tokencount
from tidemark.llm.bpe import Encoder, Model, split_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(encoder, text):
    cut = split_pieces(text)
    return encoder.encode([cut[0], *(" " + p for p in cut[1:])])[0].tolist() if cut else []


def strange(n):
    rng = random.Random(11)
    alphabet = [*"aab  \n\t'sSlLeE12.!é　\x85\x1c 😀ß中՘ก\x00", "<|endoftext|>", " <|endoftext|> ", "the ", "aaaa", "'ve"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_equal_the_library(library):
    encoder = Encoder(Model.load(PATH))
    for text in strange(1500):
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_runs(library):
    encoder = Encoder(Model.load(PATH))
    for text in ("a" * 5001, "ab" * 3000, " " * 777 + "x", "\n" * 300, "x" * 100 + "é" * 999):
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_counts(spark, frame, library, data):
    docs = [(i, t) for i, t in enumerate(strange(200))] + [(500, None), (None, "abc"), (7, "repeat"), (7, "repeat")]
    docs.append((501, "word " * 60000))
    for memo in (tokencount.MEMO, 3):
        got = tokencount.count_tokens(frame(docs), PATH, limit=20, memo=memo).collect()
        want = []
        for i, t in docs:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            want.append((i, len((t or "").encode()), n, n > 20))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokencount.count_tokens(frame([]), PATH).count() == 0


def test_given_table(spark, data, library):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op7_token_counts(spark, data).collect()
    assert len(got) == len(text)
    for r in got:
        assert r["n_tokens"] == len(library.encode(text[r["doc_id"]], add_special_tokens=False).ids)
