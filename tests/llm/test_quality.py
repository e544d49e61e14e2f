"""Held-out accuracy, and the blocked vote against one row at a time."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality, queries

SF = "/root/testdata/sf0.1"


def out(doc):
    return zlib.crc32(str(doc).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    got = queries.op4_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == out(r["doc_id"]) for r in got)
    held = [r for r in got if r["held_out"]]
    right = lambda label: np.mean([r["predicted"] == r["quality"] for r in held if r["quality"] == label])
    assert len(held) > 1000 and right(1) > 0.97 and right(0) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_vote_is_exact():
    rng = np.random.default_rng(3)
    rows = rng.random((300, quality.FEATURES)).astype(np.float32)
    labels = rng.integers(0, 2, 300)
    voter = quality.Voter(rows, labels, 0.4)
    probes = rng.random((1100, quality.FEATURES)).astype(np.float32)
    got = voter.score(probes)
    unit = voter.project(probes)
    for k in (0, 511, 512, 1099):
        near = np.array([float(unit[k] @ v) for v in voter.vectors])
        best = np.argsort(-near)[: voter.neighbours]
        weight = np.maximum(near[best], 0) ** quality.SHARPNESS
        want = ((weight * labels[best]).sum() + 0.01 * 0.4) / (weight.sum() + 0.01)
        assert abs(got[k] - want) < 1e-4


def test_edges(spark, frame):
    good, bad = "The plain words of a sentence stand here.", "JUNK!! JUNK!! JUNK!! JUNK!! JUNK!!"
    docs = [(k, good if k % 2 else bad) for k in range(40)] + [(100, None), (101, ""), (None, good), (3, good), (102, "x" * 300000)]
    labels = [(k, k % 2) for k in range(40)] + [(None, 1), (5, None), (7, 1), (9999, 0)]
    table = frame(docs).withColumn("score", F.lit("clash")).withColumn("label", F.lit(1))
    voter = quality.fit(table, labelled(spark, labels))
    got = {r["doc_id"]: r["predicted"] for r in quality.classify(table, voter).collect() if r["doc_id"] not in (100, 101, 102)}
    assert all(got[k] == k % 2 for k in range(40)) and got[None] == 1
    kept = quality.keep_good(table, voter)
    assert kept.columns == table.columns and kept.where("text like 'JUNK%'").count() == 0 and kept.where(F.col("text") == good).count() == 22
    assert quality.classify(frame([]), voter).count() == 0
    none = quality.fit(table, labelled(spark, []))
    assert {r["score"] for r in quality.classify(table, none).collect()} == {0.5}
    one = quality.fit(table, labelled(spark, [(k, 1) for k in range(9)]))
    assert quality.classify(table, one).where("predicted = 0").count() == 0


def test_scores_use_only_the_text(spark, frame):
    docs = [(k, "same text here") for k in range(9)]
    voter = quality.fit(frame(docs), labelled(spark, [(k, k % 2) for k in range(9)]))
    assert quality.classify(frame(docs), voter).select("score").distinct().count() == 1


def test_score_is_alike_below_and_above_the_bound(spark, frame):
    # One kind of text, of which one in seven is of label 0.
    docs = [(k, f"The plain words of sentence {k} stand here.") for k in range(840)]
    labels = labelled(spark, [(k, int(k % 7 > 0)) for k in range(840)])
    fixed = np.array([quality.features("The plain words of this sentence stand here.")])
    below, above = (quality.fit(frame(docs), labels, sample=n, neighbours=60) for n in (4000, 60))
    assert (below.votes == 1).all() and len(above.labels) == 60 and above.labels.mean() == 0.5
    assert abs(below.score(fixed)[0] - 6 / 7) < 0.12 and abs(above.score(fixed)[0] - 6 / 7) < 0.05
