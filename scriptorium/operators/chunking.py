"""Overlapping chunks that end at punctuation where they can.

A chunk's start depends on the cut before it, so a document is cut in order;
documents are independent.  Position arithmetic runs in an Arrow UDF, which
measured several times faster than the same recursion in higher-order functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CUT_LOOKBACK, Profile
from ..functions.text import normalize_text
from ..shared import bounded_batches

#: Fixed value: a chunk may end after one of these.
CUT_MARKS = "。！？；\n"
CHUNK_TYPE = "array<struct<start:int,end:int,chunk_text:string>>"


def find_good_cut(text: str, start: int, hard_end: int, lookback: int = CUT_LOOKBACK) -> int:
    """The place after the last mark in the last ``lookback`` characters before hard_end, else hard_end."""
    low = max(start + 1, hard_end - lookback)
    last = max(text.rfind(mark, low, hard_end) for mark in CUT_MARKS)
    return hard_end if last < 0 else last + 1


def next_start(start: int, end: int, overlap: int) -> int:
    """Where the chunk after [start, end) begins: ``overlap`` before its end, or at its end where it is no longer than the overlap."""
    return end - overlap if end - overlap > start else end


def cut(text: str, size: int, overlap: int, at: int = 0) -> Iterator[tuple[int, int]]:
    """[start, end) of all full chunks from ``at`` on; the rest from the next start on is the tail."""
    while len(text) - at >= size:
        end = find_good_cut(text, at, at + size)
        yield at, end
        at = next_start(at, end, overlap)


def chunks_of(text: str | None, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, stripped text) of all non-empty chunks, the tail included."""
    if not text:
        return []
    out, at = [], 0
    for start, end in cut(text, size, overlap):
        out.append((start, end, text[start:end].strip()))
        at = next_start(start, end, overlap)
    out.append((at, len(text), text[at:].strip()))
    return [c for c in out if c[2]]


def _chunker(size: int, overlap: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chunk_text", pa.string())]))

    @F.arrow_udf(CHUNK_TYPE)
    def chunks(text: pa.Array) -> pa.Array:
        names = ("start", "end", "chunk_text")
        return pa.array([[dict(zip(names, c)) for c in chunks_of(t, size, overlap)] for t in text.to_pylist()], kind)

    return chunks


def chunks_of_texts(profile: Profile):
    """A function of a text column: the array of its chunks (start, end, chunk_text)."""
    return _chunker(profile.chunk_size, profile.overlap)


def chunk_documents(documents: DataFrame, profile: Profile, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chunk_id, chunk_text, start, end, *keep) of documents with one text each; chunk ids run from 0."""
    bounded_batches(documents.sparkSession)
    pieces = _chunker(profile.chunk_size, profile.overlap)(normalize_text(F.col(text)))
    # the outer form keeps the optimiser from writing the array expression twice
    out = documents.select("doc_id", *keep, F.posexplode_outer(pieces).alias("chunk_id", "c")).where("c is not null")
    return out.select("doc_id", F.col("chunk_id").cast("int").alias("chunk_id"), "c.chunk_text", "c.start", "c.end", *keep)


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): normalised non-empty pages of each document in page order, one line feed between them."""
    p = pages.select("doc_id", "page_no", normalize_text(F.col("text")).alias("text")).where("text <> ''")
    ordered = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return p.groupBy("doc_id").agg(F.array_join(ordered["text"], "\n").alias("text"))


def chunk_lookup(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """keys(doc_id, chunk_id, ...) with the chunk_text of their chunk, null where there is none: any item leads back to its text."""
    return keys.join(chunks.select("doc_id", "chunk_id", "chunk_text"), ["doc_id", "chunk_id"], "left").select(*keys.columns, "chunk_text")


def chunk_pages(pages: DataFrame, profile: Profile) -> DataFrame:
    """Chunks of documents given as pages (doc_id, page_no, text); chunks may span pages."""
    bounded_batches(pages.sparkSession)
    pieces = _chunker(profile.chunk_size, profile.overlap)(F.col("text"))
    out = join_pages(pages).select("doc_id", F.posexplode_outer(pieces).alias("chunk_id", "c")).where("c is not null")
    return out.select("doc_id", F.col("chunk_id").cast("int").alias("chunk_id"), "c.chunk_text", "c.start", "c.end")
