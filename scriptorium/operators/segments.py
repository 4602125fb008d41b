"""Chunks split at item markers into groups of items, each under the chunk's head."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MARKERS
from ..functions.text import BLANKS, normalize_text
from ..shared import bounded_batches


def grouper(per_request: int, markers: tuple[str, ...]) -> Callable[[str], list[str]]:
    """A chunk's segments; a chunk without a marker is one."""
    broken = [(re.compile(f"[{re.escape(BLANKS)}]*{re.escape(m)}[{re.escape(BLANKS)}]*"), "\n" + m) for m in markers]

    def groups(text: str) -> list[str]:
        if not any(m in text for m in markers):
            return [text]
        lines = text
        for pattern, mark in broken:
            lines = pattern.sub(lambda _, mark=mark: mark, lines)
        head, items = [], []
        for line in lines.split("\n"):
            if line := line.strip(BLANKS):
                (items if line.startswith(markers) else head).append(line)
        if not items:
            return [text]
        return ["\n".join([*head, *items[at : at + per_request]]).strip(BLANKS) for at in range(0, len(items), per_request)]

    return groups


def marker_segments(chunks: DataFrame, enabled: bool = False, per_request: int = 6, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """chunks(doc_id, chunk_id, chunk_text) to (doc_id, chunk_id, seg_id, seg_text).

    Disabled, or without a marker, a chunk is one segment.  Else every line that
    starts with a marker is an item, all other lines - those after an item too -
    make the head, which stands before each group of ``per_request`` items.  Lines
    are cut by an Arrow function: array functions over them are interpreted and took
    several times as long.
    """
    d = chunks.select("doc_id", "chunk_id", normalize_text(F.col("chunk_text")).alias("t"))
    if not enabled:
        return d.select("doc_id", "chunk_id", F.lit(0).alias("seg_id"), F.col("t").alias("seg_text"))
    bounded_batches(chunks.sparkSession)
    groups = grouper(per_request, tuple(markers))

    @F.arrow_udf("array<string>")
    def segments(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else groups(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    out = d.select("doc_id", "chunk_id", F.posexplode_outer(segments("t")).alias("seg_id", "seg_text"))
    return out.where("seg_text is not null").select("doc_id", "chunk_id", F.col("seg_id").cast("int").alias("seg_id"), "seg_text")
