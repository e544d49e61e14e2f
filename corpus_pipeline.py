"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir) and is written as Parquet before the next
one reads it. All but the last return the columns of ``documents``; the number of
characters follows the text.
"""

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import codec, decontam, neardup, pii, quality
from tidemark.llm.common import store

TOKENIZER = "byte_bpe_50k.json"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counted(docs, before):
    """``n_chars`` of the text as it is now; columns and their types stay."""
    counted = docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return counted.select(*before.columns)


def good_quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    voter = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, voter)


def one_of_each(spark, docs, sf_dir):
    """Of every group of near duplicates (five words, 0.8) one document stays."""
    return neardup.drop_near_duplicates(docs)


def without_benchmarks(spark, docs, sf_dir):
    """Contaminated documents go; benchmark passages are cut out of the others."""
    return _counted(decontam.clean(docs, _table(spark, sf_dir, "benchmark")), docs)


def without_personal_data(spark, docs, sf_dir):
    """Identifiers give way to the name of their kind."""
    return _counted(pii.mask(docs), docs)


def token_ids(spark, docs, sf_dir):
    """Token ids of every document that is left, and the text they decode to."""
    return codec.encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("personal data", without_personal_data),
    ("tokens", token_ids),
]

# Near duplicates, votes and tokens can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each is stored in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
