"""JSON Lines, chunk artifacts, dead letters and split sinks; each run replaces its output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_BAD_DUMPS, MAX_SAVED_CHUNKS


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line, UTF-8 unescaped, null fields kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_chunks(chunks: DataFrame, path: str, cap: int = MAX_SAVED_CHUNKS) -> None:
    """The first ``cap`` chunks of each document, a folder for each."""
    chunks.where(F.col("chunk_id") < cap).select("doc_id", "chunk_id", F.col("chunk_text").alias("value")).write.mode("overwrite").partitionBy("doc_id", "chunk_id").text(path)


def write_dead_letters(failed: DataFrame, path: str, cap: int = MAX_BAD_DUMPS) -> None:
    """The first ``cap`` failures by document and chunk, in two headed sections: the chunk, and the response."""
    text = F.concat(F.lit("=== CHUNK TEXT ===\n"), "chunk_text", F.lit("\n\n=== RAW MODEL RESPONSE ===\n"), F.coalesce("raw", F.lit("")))
    failed.orderBy("doc_id", "chunk_id").limit(cap).select("doc_id", "chunk_id", text.alias("value")).write.mode("overwrite").partitionBy("doc_id", "chunk_id").text(path)


def write_split(train: DataFrame, valid: DataFrame, test: DataFrame, path: str) -> None:
    for name, rows in (("train", train), ("valid", valid), ("test", test)):
        write_jsonl(rows, f"{path}/{name}.jsonl")
