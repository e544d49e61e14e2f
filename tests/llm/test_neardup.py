"""Near-duplicate groups against all pairs of shingle sets."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neardup, queries
from tidemark.llm.components import components

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = TOKEN.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(docs, size=3, percent=85):
    sets = [(i, shingles(t, size)) for i, t in docs]
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for j in range(len(sets)):
        for k in range(j):
            a, b = sets[j][1], sets[k][1]
            if a and b and sets[j][0] is not None and sets[k][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                up[root(j)] = root(k)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(
        ((i, len(s), None if i is None else least[root(k)], i is None or i == least[root(k)]) for k, (i, s) in enumerate(sets)), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def made(seed=5, groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    docs = [(0, None), (1, ""), (2, "  \n"), (3, "One"), (4, "one"), (5, "one two"), (None, "one"), (6, "\x00x \x85y")]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 40, 200]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = word()
            docs.append((len(docs) + 100, " ".join(w)))
    for _ in range(40):
        docs.append((len(docs) + 100, " ".join([word() for _ in range(rng.randint(1, 15))] + passage + [word() for _ in range(rng.randint(1, 15))])))
    docs += [(110, docs[9][1]), (111, docs[30][1]), (9000, docs[12][1].upper()), (9001, docs[12][1].upper())]
    return docs


@pytest.mark.parametrize("star_rounds", [1, 0, 2])
def test_equals_all_pairs(spark, frame, star_rounds):
    docs = made()
    got = neardup.groups(frame(docs).withColumn("node", F.lit(1)).withColumn("component", F.lit("x")), star_rounds=star_rounds)
    want = brute(docs)
    assert rows(got) == want
    assert len({r[2] for r in want}) < len(want) - 20


def test_five_words_at_eighty(spark, frame):
    docs = made(8, 6)
    assert rows(neardup.groups(frame(docs), size=5, percent=80)) == brute(docs, 5, 80)


def test_given_table(spark, data):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    assert rows(queries.op9_near_duplicates(spark, data)) == brute(docs)


def test_empty_and_single(spark, frame):
    assert rows(neardup.groups(frame([]))) == []
    assert rows(neardup.groups(frame([(7, None)]))) == [(7, 0, 7, True)]


def test_signature_of_small_sets():
    signer, shingle = neardup.Signer(), neardup.Shingler(3)
    a = shingle("a b c d e f g h")
    assert (signer(a) == signer(shingle("A b c d e f g h"))).all()
    assert not (signer(a) == signer(shingle("z y x w v u t s"))).any()


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 50), (7, 7), (60, 61)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 50, 50: 50, 60: 60, 61: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_keeps_one_row_of_a_group(spark, frame):
    docs = frame([(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (2, None), (None, "x"), (4, "other words here")])
    got = neardup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(
        [(1, "A b c d e f"), (2, None), (None, "x"), (4, "other words here")], key=repr)


def test_unlike_texts_of_one_id_both_stay(spark):
    rows = [(1, "a b c d e f g", {"k": 1}), (1, "v w x y z u t", {"k": 2}), (1, "a b c d e f g", {"k": 0}), (2, "A b c d e f g", {"k": 3}), (3, "", None), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row map<string,int>").withColumnRenamed("_row", "row")
    got = neardup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "", r["row"]) for r in got.collect()), key=repr) == sorted(
        [(1, "a b c d e f g", {"k": 0}), (1, "v w x y z u t", {"k": 2}), (3, "", None)], key=repr)


def test_large_buckets_are_cut(spark, frame, monkeypatch):
    monkeypatch.setattr(neardup, "PART_MEMBERS", 3)
    rng = random.Random(8)
    shared = " ".join(f"s{k}" for k in range(80))
    docs = [(k, shared + " " + " ".join(f"o{rng.randrange(10_000)}" for _ in range(14))) for k in range(40)]
    docs += [(100 + k, docs[k][1] + " x") for k in range(0, 40, 3)]
    assert sorted(map(tuple, neardup.groups(frame(docs)).collect())) == sorted(brute(docs))
