"""Spans of a document's text and the chunks that hold them: an interval join in buckets.

Chunks overlap, so a span may lie in several.  Both sides meet in buckets of
positions, so neither a long document nor many spans in it make a large group, and
a pair counts in one bucket only, so that no distinct follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text

#: Positions in a bucket.
BUCKET = 1 << 11


def page_offsets(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_no, text) that are not empty, normalised, with ``at``: where each begins in its document's joined text.

    Only lengths are summed in the window, texts are joined on after it; pages of one number are an error of
    their source, and each of them gets the place of the whole.
    """
    p = pages.select("doc_id", "page_no", normalize_text(F.col("text")).alias("text")).where("text <> ''")
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    lengths = p.groupBy("doc_id", "page_no").agg(F.sum(F.length("text") + 1).alias("_n"))
    at = lengths.select("doc_id", "page_no", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long").alias("at"))
    return p.join(at, ["doc_id", "page_no"])


def quote_spans(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes(doc_id, page_no, quote, ...) with start and end in the document's joined text.

    The first place on the quote's page counts; a quote that is null, empty or not
    on its normalised page has null places.
    """
    p = page_offsets(pages).select("doc_id", "page_no", F.col("text").alias("_page"), F.col("at").alias("_at"))
    d = quotes.join(p, ["doc_id", "page_no"], "left")
    found = F.when((F.col("quote") != "") & (F.instr("_page", F.col("quote")) > 0), F.instr("_page", F.col("quote")) - 1)
    start = F.col("_at") + found
    return d.select(*[F.col(f"`{c}`") for c in quotes.columns], start.alias("start"), (start + F.length("quote")).alias("end"))


def chunks_of_spans(spans: DataFrame, chunks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(columns of spans, chunk_id, whole): a row for each chunk that shares a position with the span [start, end).

    ``whole`` tells that the chunk holds all of it.  An empty span lies in the
    chunks that hold its place; a null place, or an end before the start, in none.
    Repeated spans each stay.  Columns of chunks other than chunk_id don't come along.
    """
    until = lambda: F.greatest(F.col("end"), F.col("start") + 1)
    buckets = lambda: F.explode(F.sequence(F.floor(F.col("start") / bucket).cast("long"), F.floor((until() - 1) / bucket).cast("long"))).alias("_b")
    row = F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("_s")
    left = spans.where("doc_id is not null and end >= start").select("doc_id", row, F.col("start").alias("_ss"), F.col("end").alias("_se"), until().alias("_su"), buckets())
    right = chunks.where("end > start").select("doc_id", "chunk_id", F.col("start").alias("_cs"), F.col("end").alias("_ce"), buckets())
    first_shared = F.floor(F.greatest("_ss", "_cs") / bucket) == F.col("_b")
    met = left.join(right, ["doc_id", "_b"]).where((F.col("_ss") < F.col("_ce")) & (F.col("_cs") < F.col("_su")) & first_shared)
    return met.select("_s.*", "chunk_id", ((F.col("_cs") <= F.col("_ss")) & (F.col("_se") <= F.col("_ce"))).alias("whole"))
