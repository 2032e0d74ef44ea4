"""From documents to packed training sequences: toxicity, language, near-duplicates, packing.

Each stage takes the documents that the one before it kept and returns the columns of documents; the last
returns the packed pieces. SQL cannot express the stages, so ORACLE_SQL is None; tests/llm/test_pipeline.py holds
what each stage keeps against the operator's own verdicts, near-duplicates and packing against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dispatchtext.llm import language, near_text, packing, toxicity
from dispatchtext.llm.common import materialize, table

import public_tokenizers  # isort: skip  (after the subpackage, whose absence the entry looks for)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. The model learns from the labelled rows of sf_dir."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without one clear learned language, go."""
    return language.keep_known(docs, language.train(table(spark, sf_dir, "documents")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: the one with the smallest doc_id.

    Links are those of the SimHash operator's covering masks, and those of min-hash bands for the pairs that fingerprints miss.
    """
    return near_text.deduplicate(docs, fingerprints=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents left, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
