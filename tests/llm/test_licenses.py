"""Matching statistics against brute force, base places against word lists."""

import random
import re

import duckdb

from tidemark.llm import licenses, queries
from tidemark.llm.common import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(doc, text):
    w = WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return (doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def made():
    rng = random.Random(4)
    pool = "under the mit License apache version 2 cc by nc CC-BY-NC of é".split()
    docs = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    return docs + [(500, None), (501, ""), (None, "cc by nc"), (1, "cc by nc"), (1, "cc by nc"), (502, "cc by nc " * 30000)]


def test_base_places(spark, frame):
    docs = made()
    assert rows(licenses.scan(frame(docs))) == sorted((brute(*d) for d in docs), key=repr)


def test_given_table(spark, data):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    got = queries.op2_licenses(spark, data)
    assert rows(got) == sorted((brute(*d) for d in docs), key=repr)
    assert got.where("labels <> ''").count() > 0 and got.where("score < 0 or score > 1").count() == 0


def test_matching_statistics():
    rng = random.Random(6)
    templates = [("t", " ".join(rng.choice("abc") for _ in range(rng.randint(3, 25)))) for _ in range(6)]
    automaton = licenses.Automaton(templates, {"a b a": "x", "c": "y"})
    texts = [t.encode().split() for _, t in templates] + [b"a b a".split(), b"c".split()]
    parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(150):
        w = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(30)]
        ends = {}
        for end in range(1, len(w) + 1):
            ends[end] = max((end - i for i in range(end) if tuple(w[i:end]) in parts), default=0)
        want = [(e, n) for e, n in ends.items() if n >= 3 and ends.get(e + 1, 0) <= n]
        base, anchors = automaton.stream(w, 3)
        assert [(e, n) for e, n, _ in anchors] == want
        assert sorted(base) == sorted([(i, "x") for i in range(28) if w[i : i + 3] == [b"a", b"b", b"a"]] + [(i, "y") for i in range(30) if w[i] == b"c"])


def test_whole_and_damaged_notices(spark, frame):
    label, text = licenses.TEMPLATES[0]
    w = text.split()
    damaged = " ".join(w[:20] + ["WRONG", "words"] + w[22:])
    got = {r["doc_id"]: r for r in licenses.scan(frame([(1, "start " + text + " end"), (2, damaged), (3, " ".join(w[:9])), (4, " ".join(reversed(w)))])).collect()}
    assert got[1]["labels"] == label and got[1]["score"] == 1.0
    assert (got[1]["spans"][0]["start"], got[1]["spans"][0]["end"]) == (1, 1 + len(words(text)))
    assert got[2]["labels"] == label and 0.9 < got[2]["score"] < 1
    assert got[3]["labels"] == "" and got[4]["labels"] == ""
    assert licenses.scan(frame([])).count() == 0
