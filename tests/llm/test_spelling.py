"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import spelling

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def brute(docs):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    rows, forms = {}, {}
    for w, c in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * c:
            forms[w] = best
        rows[w] = len(others)
    out = []
    for w, c in words.items():
        root = w
        while root in forms:
            root = forms[root]
        f = forms.get(w)
        out.append((w, f, root, c, rows[w], words[f] if f else None))
    return sorted(out, key=repr)


def found(docs, **options):
    return sorted((tuple(r) for r in spelling.variants(docs, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 11))) for _ in range(30)]
    bases += ["prefixes" + "".join(rng.choice("abç") for _ in range(4)) for _ in range(40)]
    docs = []
    for k in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(bases)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abé") + w[p:], w[:p] + rng.choice("abé") + w[p + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((k, rng.choice([" ", ", ", "-1-"]).join(words)))
    chain = ["chainlink"] * 300 + ["chainlinc"] * 25 + ["chainlimc"] * 2
    docs += [(500 + k, " ".join(chain)) for k in range(3)]
    return docs + [(900, None), (901, ""), (902, "1234 ... ×÷"), (None, "chainlink chainlink"), (903, "abcdefg"), (903, "abcdefg"), (904, "É" * 9 + " " + "É" * 8 + " " + "É" * 9 + " " + "É" * 8)]


@pytest.mark.parametrize("longest", [spelling.LIST, 30])
def test_equals_all_pairs(frame, corpus, longest):
    got = found(frame(corpus), longest=longest)
    assert got == brute(corpus)
    assert any(f and r != f for _, f, r, *_ in got)


def test_lists_stay_short(spark):
    rng = random.Random(1)
    words = {"internation" + "".join(rng.choice("abcd") for _ in range(6)) for _ in range(2000)}
    vocab = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    sizes = spelling.lists(vocab, 600).groupBy("key").agg(F.sum(F.length("middle")).alias("c"), F.max(F.expr("b - a")).alias("w")).collect()
    assert max(r["c"] for r in sizes if r["w"] > 1) <= 600
    assert max(r["c"] for r in sizes) < 1000


def test_very_long_words(frame):
    long = "ab" * 6000
    docs = [(1, f"{long} {long}"), (2, f"{long}x {long}x {long[1:]} {long[1:]}")]
    assert found(frame(docs)) == brute(docs)


def test_scan_of_small_alphabets():
    rng = random.Random(2)
    for _ in range(100):
        of, middles = [], []
        for k in range(rng.randint(1, 4)):
            size = rng.randint(0, 4)
            some = sorted({"".join(rng.choice("abß") for _ in range(rng.choice([size, size + 1]))) for _ in range(rng.randint(1, 15))})
            of += [k] * len(some)
            middles += some
        i, j, shared = spelling.near_pairs(np.array(of), middles)
        want = [(x, y) for x in range(len(of)) for y in range(x + 1, len(of)) if of[x] == of[y] and near(middles[x], middles[y])]
        assert sorted(zip(i.tolist(), j.tolist())) == want
        for x, y, s in zip(i, j, shared):
            assert middles[x][:s] == middles[y][:s] and middles[x][s : s + 1] != middles[y][s : s + 1]


def test_empty_table_and_clashing_columns(frame):
    assert found(frame([])) == []
    docs = frame([(1, "variants variants varients")] * 12)
    for name in ("word", "run", "id", "n", "key", "size", "h", "at"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(docs) == brute([(1, "variants variants varients")] * 12)
