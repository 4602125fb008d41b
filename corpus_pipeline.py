"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last keep the columns of ``documents``, with
whatever names, and a repeated row or a null is treated as its operator says.  An
empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontamination, language, near_dedup, packing, pii
from scriptorium.llm.storage import materialise, read_table, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the model can tell go: null text, text without a letter, doubtful text.

    The model learns from all documents that name their language.
    """
    return language.keep_identified(docs, language.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of least doc_id: five-word shingles, similarity 0.8."""
    return near_dedup.keep_first(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go."""
    return decontamination.remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' token ids in sequences of 1,024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL has no models, no tokenizer and no packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read again, and deleted after the next."""
    docs = read_table(spark, sf_dir, "documents")
    last = []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
