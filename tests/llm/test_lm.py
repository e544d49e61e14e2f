"""The backoff automaton against a walk over plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tidemark.llm import lm, queries

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
START, END = object(), object()


def held(doc, modulus=7, remainder=2):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % modulus == remainder


def brute(docs, order, strength=lm.STRENGTH):
    lines = [(d, TOKEN.findall((t or "").translate(LOWER)) + [END]) for d, t in docs]
    count, histories = Counter(), Counter()
    for d, w in lines:
        if not held(d):
            padded = [START] * (order - 1) + w
            for i in range(order - 1, len(padded)):
                for n in range(order):
                    count[tuple(padded[i - n : i + 1])] += 1
                    histories[tuple(padded[i - n : i])] += 1
    unigrams = [k for k in count if len(k) == 1]
    total, distinct = sum(count[k] for k in unigrams), len(unigrams)
    out = []
    for d, w in lines:
        base = score = 0.0
        padded = [START] * (order - 1) + w
        for i in range(order - 1, len(padded)):
            p = (count[(padded[i],)] + 1) / (total + distinct + 1)
            base += math.log10(p)
            for n in range(1, order):
                h = tuple(padded[i - n : i])
                if histories[h]:
                    p = (count[h + (padded[i],)] + strength * p) / (histories[h] + strength)
            score += math.log10(p)
        out.append((d, held(d), len(w), sum(count[(x,)] > 0 for x in w), total, base, score))
    return sorted(out, key=repr)


def check(got, want):
    got = sorted(map(tuple, got.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def made():
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["a", "A", "b", "é", "c,", "\x00", "dd"]) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    return docs + [(100, None), (101, ""), (None, "a b"), (3, "a b a"), (3, "a b a"), (102, "new words only"), (103, "a " * 50000)]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("options", [{}, {"block_bytes": 200, "bucket_bytes": 300}])
def test_equals_dictionaries(spark, frame, order, options):
    if options and order == 1:
        return
    docs = made()[:-1] if options else made()
    check(lm.score(frame(docs), order=order, **options), brute(docs, order))


def test_given_table(spark, data):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    check(queries.op6_language_model(spark, data), brute(docs, lm.ORDER))


def test_query_uses_trigrams(spark, frame, folder):
    docs = made()[:-1]
    frame(docs).write.parquet(f"{folder}/documents.parquet")
    check(queries.op6_language_model(spark, folder), brute(docs, 3))


def test_held_out_texts_score_better_than_unigrams(spark, data):
    row = queries.op6_language_model(spark, data).where("held_out").selectExpr("avg(score / n_tokens) s", "avg(base_score / n_tokens) b").first()
    assert row["s"] > row["b"]


def test_no_training_rows(spark, frame):
    assert lm.score(frame([])).count() == 0
    doc = next(i for i in range(100) if held(i))
    row = lm.score(frame([(doc, "a b")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)
