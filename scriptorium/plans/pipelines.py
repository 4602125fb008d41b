"""End-to-end plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import API, EVENT_TYPES, LOCAL, Profile
from ..functions import text as tx
from ..operators import chunking, evidence, items, parsing, segments, training
from ..shared import written
from .extractors import Extractor, extract, rule_items


def _answers(pieces: DataFrame, make: Callable[[], Extractor], prompt: Column, threads: int = 1) -> DataFrame:
    """pieces with raw and error, written: each piece is sent once, whatever is read of the answers."""
    return written(extract(pieces.withColumn("prompt", prompt), make, "prompt", threads).drop("prompt"), "answers")


def local_extraction(pages: DataFrame, make: Callable[[], Extractor], profile: Profile = LOCAL, system: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, dead letters) of a lenient model: no validation, no deduplication; failed chunks keep their ids.

    With ``system`` the model gets a chunk in its frame, else the bare chunk.
    """
    chunks = chunking.chunk_pages(pages, profile)
    asked = F.col("chunk_text") if system is None else tx.prompt(F.col("chunk_text"), system)
    parsed = parsing.parse_responses(_answers(chunks, make, asked))
    good = parsing.explode_items(parsed.where("error is null and parsed_ok").drop("error", "raw"))
    bad = parsed.where("error is not null or not parsed_ok").select("doc_id", "chunk_id", "chunk_text", F.coalesce("error", "raw").alias("raw"))
    return good.drop("chunk_text", "start", "end"), bad


def api_extraction(pages: DataFrame, make: Callable[[], Extractor], profile: Profile = API, threads: int = 8, system: str | None = None) -> DataFrame:
    """Validated, grounded items of a structured service, the first of equal ones in a document; a failed segment gives none.

    With ``system`` the service gets a segment as a JSON list of chat messages, else the bare segment.
    """
    chunks = chunking.chunk_pages(pages, profile)
    pieces = segments.marker_segments(chunks, profile.split_on_markers, profile.markers_per_request)
    asked = F.col("seg_text") if system is None else F.to_json(tx.chat_prompt(F.col("seg_text"), system))
    parsed = parsing.parse_responses(_answers(pieces, make, asked, threads).where("error is null").drop("error"), EVENT_TYPES)
    found = parsing.explode_items(parsed.where("parsed_ok").drop("raw"))
    found = items.normalize_items(found, profile.exclude_title_like, profile.normalize_kinship)
    return items.dedup(items.ground(found))


def rule_extraction(documents: DataFrame, profile: Profile = LOCAL) -> DataFrame:
    """The whole chain with the rule extractor: chunk, extract, normalise, ground, deduplicate."""
    pieces = segments.marker_segments(chunking.chunk_documents(documents, profile))
    return items.dedup(items.ground(items.normalize_items(rule_items(pieces))))


def training_data(cells: DataFrame, key: str, column: str = "Related Texts", leak_free: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, valid, test) prompts and completions of literal cells of tagged texts."""
    # three splits read them
    examples = written(training.prompt_completion(training.training_examples(parsing.parse_cells(cells, column))), "examples")
    return training.split(examples, key, leak_free=leak_free)


def validation(entities: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) entities."""
    return evidence.split_by_status(evidence.validate_evidence(entities, pages))
