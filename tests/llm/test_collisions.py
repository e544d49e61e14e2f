"""Nearest vectors: recall and exact scores against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collisions, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    """Nearest of every query by exact products over the float32 components."""
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in ok:
        if i is not None and i % every == 0:
            scored = [((v * q).sum(), j) for j, v in ok if j != i]
            scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            out += [(i, r, j, s) for r, (s, j) in enumerate(scored[:k], 1)]
    return out


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return [tuple(r) for r in collisions.nearest(frame, **options).orderBy("query_id", "rank").collect()]


def recall(got, want):
    want = {(q, j) for q, _, j, _ in want}
    return len(want & {(q, j) for q, _, j, _ in got}) / len(want)


@pytest.mark.parametrize("kind", ["sphere", "lengths", "clusters"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 24))
    if kind == "clusters":
        v = rng.standard_normal((10, 24))[rng.integers(0, 10, 1500)] + 0.2 * v
    if kind != "lengths":
        v /= np.sqrt((v * v).sum(axis=1))[:, None]
    rows = [(k, x) for k, x in enumerate(v.astype(np.float32).tolist())]
    got, want = found(spark, rows, shard_rows=100, query_bytes=24 * 8 * 30), brute(rows)
    assert len(got) == len(want) and recall(got, want) >= 0.95
    exact = {i: np.array(x, dtype=np.float32).astype(float) for i, x in rows}
    by_query = {}
    for q, r, j, s in got:
        assert s == pytest.approx(float((exact[q] * exact[j]).sum()), abs=1e-12) and q != j
        by_query.setdefault(q, []).append((r, -s, j))
    for found_rows in by_query.values():
        assert found_rows == sorted(found_rows) and [x[1:] for x in found_rows] == sorted(x[1:] for x in found_rows)
        assert [x[0] for x in found_rows] == list(range(1, len(found_rows) + 1))


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(1)
    rows = [(k * 20, x) for k, x in enumerate(rng.standard_normal((8, 5)).astype(np.float32).tolist())]
    got, want = found(spark, rows), brute(rows)
    assert [x[:3] for x in got] == [x[:3] for x in want]


def test_unusable_ties_and_repeated(spark):
    one, two = [1.0, 0.0, 0.5], [0.5, 2.0, 0.0]
    rows = [(0, one), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [1.0, float("nan"), 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [1.0]), (None, two)]
    rows += [(k, two) for k in range(30, 60, 2)] + [(k, one) for k in (9, 8, 8)]
    got = found(spark, rows, k=6)
    kept = [(i, v) for i, v in rows if i != 7]
    want = brute(kept, k=6)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    everything = found(spark, rows, k=40)
    assert sorted(everything, key=repr) == sorted(brute(kept, k=40), key=repr)
    assert any(j is None for _, _, j, _ in everything)


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, []) == [] and found(spark, [(0, None)]) == [] and found(spark, [(1, [1.0]), (2, [2.0])]) == []
    frame = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0)], SCHEMA)
    for name in ("row", "v", "shard", "query", "score", "block", "rank"):
        frame = frame.withColumn(name, F.lit("x"))
    assert [tuple(r) for r in collisions.nearest(frame).collect()] == [(0, 1, 1, 1.0)]


def test_registered_query_recall(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    want = brute([(r["vec_id"], r["embedding"]) for r in table])
    got = [tuple(r) for r in queries.op13_nearest_vectors(spark, data).collect()]
    assert len(got) == len(want) and recall(got, want) >= 0.9


def test_waves_cover_all_shards():
    for n in (1, 2, 9, 100, 5000):
        assert [s for b, e in collisions.waves(n) for s in range(b, e)] == list(range(n))
