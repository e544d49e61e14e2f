"""Fingerprints against a plain walk over the ordered table."""

import hashlib
import random

import duckdb
import pytest

from tidemark.llm import chunking, queries


def brute(docs):
    def key(d):
        return (-(d[0] if d[0] is not None else -(2**63)), hashlib.blake2b((d[1] or "").encode(), digest_size=16).digest())

    order = sorted(docs, key=key)
    out = []
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        a, b, c = chunking.chunks(text), chunking.chunks(edited), chunking.chunks(following)
        out.append((doc, n, hashlib.sha256(edited.encode()).hexdigest(), chunking.written(a), chunking.written(b), chunking.containment(a, b), chunking.containment(a, c)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("part_bytes", [chunking.PART_BYTES, 500])
def test_neighbours(spark, frame, part_bytes):
    rng = random.Random(1)
    docs = [(rng.randrange(10**6), prose(rng, rng.randint(0, 120))) for _ in range(70)]
    docs += [(None, "no id"), (None, None), (10**7, None), (docs[0][0], "same id"), (docs[1][0], docs[1][1]), (-5, "low"), (-(2**62), "x" * 100000)]
    assert rows(chunking.compare_with_next(frame(docs), part_bytes=part_bytes)) == brute(docs)


def test_small_tables(spark, frame):
    assert rows(chunking.compare_with_next(frame([]))) == []
    for docs in ([(4, "one row only, which follows itself")], [(4, None)], [(4, "a"), (4, "a")]):
        assert rows(chunking.compare_with_next(frame(docs))) == brute(docs)


def test_given_table(spark, data):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    got = queries.op3_fingerprints(spark, data)
    assert rows(got) == brute(docs)
    assert got.where("n_chars > 300 and near_edited < 0.35").count() == 0


def test_cuts_follow_content():
    rng = random.Random(2)
    text = prose(rng, 2000)
    a, b = chunking.chunks(text), chunking.chunks("some words put before " + text)
    assert chunking.containment(a, b) > 0.97
    assert chunking.containment(a, chunking.chunks(prose(rng, 2000))) < 0.03
    data = text.encode()
    ends = chunking.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= chunking.LARGEST and min(sizes[:-1]) >= chunking.SMALLEST
    assert chunking.cuts(b"") == []
