"""The corpus pipeline, stage by stage, against brute force on its own input."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_decontam import brute as contamination, word_list
from test_neardup import brute as near
from test_pii import brute as personal
from tidemark.llm import pii, quality
from tidemark.llm.common import store
from tidemark.llm.decontam import cut_spans


@pytest.fixture(scope="module")
def passed(spark, data):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = store(stage(spark, docs, data), "stage")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(passed, spark, data):
    first = spark.read.parquet(f"{data}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert [(f.name, f.dataType) for f in passed[name][1].schema] == [(f.name, f.dataType) for f in first.schema]


def test_quality_stage(passed, spark, data):
    before, after = passed["quality"]
    voter = quality.fit(before, spark.read.parquet(f"{data}/labels.parquet"))
    good = {r["doc_id"] for r in quality.classify(before, voter).collect() if r["predicted"] == 1}
    assert set(rows(after)) == good and 0 < len(good) < before.count()
    kept = rows(before)
    assert all(r == kept[i] for i, r in rows(after).items())


def test_near_duplicate_stage(passed):
    before, after = passed["near duplicates"]
    want = {i for i, _, _, kept in near([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80) if kept}
    kept = rows(before)
    assert set(rows(after)) == want and all(r == kept[i] for i, r in rows(after).items())


def test_decontamination_stage(passed, spark, data):
    before, after = passed["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {r["doc_id"]: r["text"] for r in before.collect()}
    judged = {r[0]: r for r in contamination(docs.items(), items)}
    got = rows(after)
    assert set(got) == {i for i in docs if not judged[i][5]}
    for i, r in got.items():
        assert r["n_chars"] == len(r["text"])
        if not judged[i][2]:
            assert r["text"] == docs[i]
        else:
            assert len(word_list(r["text"])) == judged[i][1] - judged[i][2]


def test_personal_data_stage(passed):
    before, after = passed["personal data"]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(before).collect()}
    got = rows(after)
    changed = 0
    for i, r in rows(before).items():
        assert got[i]["n_chars"] == len(got[i]["text"])
        if not spans[i]:
            assert got[i]["text"] == r["text"]
        else:
            changed += 1
            assert not personal(got[i]["text"]) and "[" in got[i]["text"]
    assert changed and len(got) == before.count()


def test_token_stage(passed):
    before, after = passed["tokens"]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    got = rows(after)
    for i, r in rows(before).items():
        assert got[i]["ids"] == library.encode(r["text"], add_special_tokens=False).ids
        assert got[i]["decoded"] == r["text"]
    assert len(got) == before.count()


def test_cut_spans():
    assert cut_spans("A b, c-d e", [{"start": 1, "end": 3}]) == "A -d e"
