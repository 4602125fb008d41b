"""Evidence of entities, looked up on their page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_evidence


def validate_evidence(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """entities(doc_id, page, evidence, text, ...) with status, reason, start, end, match.

    pages(doc_id, page_no from 1, text).  Accepted with offsets if the evidence
    stands on its page as it is; accepted as ``normalized`` without offsets if it
    does after normalisation; else rejected: ``invalid page`` or ``not found``.
    Empty evidence is accepted at 0.
    """
    p = pages.select("doc_id", F.col("page_no").alias("page"), F.coalesce("text", F.lit("")).alias("_page_text"))
    d = entities.join(p, ["doc_id", "page"], "left")
    evidence = F.coalesce(F.when(F.col("evidence") != "", F.col("evidence")), F.col("text"), F.lit(""))
    d = d.withColumn("_e", evidence)
    at, known = F.instr("_page_text", F.col("_e")), F.col("_page_text").isNotNull()
    near = F.contains(normalize_evidence(F.col("_page_text")), normalize_evidence(F.col("_e")))
    exact = known & (at > 0)
    status = F.when(exact | (known & near), "accepted").otherwise("rejected")
    return d.select(
        *[F.col(c) for c in entities.columns],
        status.alias("status"),
        F.when(~known, "invalid page").when(status == "rejected", "not found").alias("reason"),
        F.when(exact, at - 1).alias("start"),
        F.when(exact, at - 1 + F.length("_e")).alias("end"),
        F.when(known & ~exact & near, "normalized").alias("match"),
    )


def split_by_status(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)."""
    return validated.where("status = 'accepted'"), validated.where("status = 'rejected'")
