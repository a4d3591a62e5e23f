"""A training corpus from documents: reject toxic ones, keep one of each near-duplicate group, sanitise personal data,
mix sources to target weights, encode.

Each stage takes (spark, docs, sf_dir); run() writes what it returns as Parquet in the shared folder and gives that to
the next. No stage looks at columns other than doc_id, text and source (and n_chars, which sanitising keeps true), and
all keep any others. Stages take empty tables, nulls, repeated rows and texts of any length as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, mixing, nearcopies, pii
from sparkloom.llm import toxicity as toxic
from sparkloom.llm.common import bounded_batches, table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go. It learns from the labelled rows of sf_dir."""
    model = toxic.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxic.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a Jaccard similarity of 0.8 or more stays, that with the smallest id; shingles of five words."""
    bounded_batches(spark)
    return nearcopies.keep_one(docs, shingle=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that reveal it replaced."""
    bounded_batches(spark)
    return pii.sanitise(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all to twice."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, vocab_path: str | None = None) -> DataFrame:
    """Token ids of each text, their number, and the text decoded from them."""
    import public_tokenizers

    bounded_batches(spark)
    path = vocab_path or public_tokenizers.path("byte_bpe_50k.json")
    return bpe.recode(docs, path).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing_sources", mixing_sources),
    ("encoding", encoding),
]

#: Hashes and models of several stages can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
