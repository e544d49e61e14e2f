"""Decontamination against brute force over windows, and its edge cases."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = word_list(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = word_list(text), set(), set()
        for n, keys in windows.items():
            for i in range(len(w) - n + 1):
                own = keys.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def rows(df):
    kept = df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in kept.collect()), key=repr)


def made():
    rng = random.Random(3)
    pick = lambda n: " ".join(rng.choice("the of and éa Bo c1 dd zz in on".split()) for _ in range(n))
    items = [(k, pick(rng.choice([1, 2, 5, 12, 13, 14, 30]) if k > 3 else 25)) for k in range(20)] + [(3, "the the"), (None, pick(15)), (77, ""), (78, None), (79, "...")]
    docs = []
    for k in range(60):
        text = pick(rng.randint(0, 80))
        if k % 3 == 0:
            text += ", " + items[k % 20][1].upper().replace(" ", "--") + " " + pick(5)
        docs.append((k, text))
    docs += [(60, None), (61, ""), (62, "..."), (None, items[0][1]), (5, docs[5][1]), (5, docs[6][1])]
    docs.append((63, " ".join([items[2][1]] * 300)))
    return docs, items


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("options", [{}, {"shard_words": 1}, {"benchmark_bytes": 300}])
def test_equals_brute_force(spark, frame, options):
    docs, items = made()
    got = decontam.report(decontam.scan(frame(docs), bench(spark, items), **options))
    assert rows(got) == brute(docs, items)


def test_given_tables(spark, data):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{data}/benchmark.parquet'").fetchall()
    want = brute(docs, items)
    assert rows(queries.op1_decontamination(spark, data)) == want
    assert any(r[5] for r in want)


def test_empty_tables(spark, frame):
    assert rows(decontam.report(decontam.scan(frame([]), bench(spark, [(1, "a b")])))) == []
    got = rows(decontam.report(decontam.scan(frame([(1, "a b")]), bench(spark, []))))
    assert [r[:4] for r in got] == [(1, 2, 0, 0)]


def test_clean_cuts_and_drops(spark, frame):
    passage = " ".join(f"w{i}" for i in range(20))
    filler = " ".join(["plain"] * 600)
    docs = frame([(1, passage), (2, f"{filler} {passage}. end"), (3, filler), (4, None), (None, passage), (2, "other")])
    docs = docs.withColumn("n_hit", F.lit(7))
    got = decontam.clean(docs, bench(spark, [(9, passage)]))
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(
        [(2, f"{filler} . end"), (2, "other"), (3, filler), (4, None)], key=repr)


def test_clean_leaves_clashing_columns(spark, frame):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = frame([(1, passage), (2, f"{'plain ' * 600}{passage}"), (3, "x")])
    names = ["own_key", "hit_id", "hit_key", "HIT_SPANS", "hit_bad", "_hit_text", "text_key", "spans"]
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"v{k}"))
    got = decontam.clean(docs, bench(spark, [(9, passage)]))
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], tuple(r[n] for n in names)) for r in got.collect()) == [(i, tuple(f"v{k}" for k in range(8))) for i in (2, 3)]


def test_clean_of_empty_tables(spark, frame):
    assert decontam.clean(frame([]), bench(spark, [(9, "a b")])).count() == 0
    assert decontam.clean(frame([(1, "a b")]), bench(spark, [])).count() == 1
