"""Chunks of documents of any length, each cut by many tasks.

Where a chunk starts depends on the chunk before, so one document's cuts look like one
task's work.  But the next start is a function of a start and of the text just after
it.  A document is dealt out in blocks of equal length, each with the text it looks
ahead to.  Every block works out for all places where a chunk may enter it where that
chain of chunks leaves it; only these short tables are chained, first within groups of
blocks, then over the groups; with its true entry each block then cuts its own chunks.
Documents that fit into one block have no such choice: each is cut in one go, as
``chunk_pages`` does, which spares most documents the tables and their groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CUT_LOOKBACK, Profile
from ..functions.text import normalize_text
from ..shared import bounded_batches, written
from .chunking import CUT_MARKS, chunks_of_texts, cut, next_start

#: Characters of a block, and blocks whose tables one task chains.
BLOCK, GROUP = 1 << 16, 1 << 10
_MARKS = np.array([ord(c) for c in CUT_MARKS], np.uint32)
#: Characters of pieces in an Arrow batch, at least one piece.
_BATCH_CHARS = 1 << 21
#: In a table: the document's last chunk begins in this block.
_LAST = -1


def next_starts(text: str, own: int, size: int, overlap: int) -> np.ndarray:
    """For each of the first ``own`` places of a text the start of the chunk after one that starts there; _LAST where the text ends before a full chunk."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    marked = np.where(np.isin(points, _MARKS), np.arange(len(points)), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(marked)]) if len(points) else np.full(1, -1)
    at = np.arange(own)
    hard = at + size
    whole = hard <= len(points)
    mark = last[np.minimum(hard, len(points))]
    end = np.where(mark >= np.maximum(at + 1, hard - CUT_LOOKBACK), mark + 1, hard)
    return np.where(whole, np.where(end - overlap > at, end - overlap, end), _LAST)


def exits(text: str, own: int, size: int, overlap: int) -> np.ndarray:
    """For each place where a chain of chunks may enter a block the place, counted from its end, where it leaves; _LAST if it ends inside."""
    after = next_starts(text, own, size, overlap)
    at = np.arange(min(size, own))
    while (inside := (at >= 0) & (at < own)).any():
        at = np.where(inside, after[np.where(inside, at, 0)], at)
    return np.where(at < 0, _LAST, at - own).astype(np.int32)


def _pieces(pages: DataFrame, block: int) -> DataFrame:
    """(doc_id, page_no, piece, chars, text), written: normalised non-empty pages in pieces of at most ``block`` characters."""
    schema = pages.select("doc_id", "page_no").withColumns({"piece": F.lit(0), "chars": F.lit(0).cast("long"), "text": F.lit("")}).schema

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, number, parts, chars = [], [], [], 0

            def made() -> pa.RecordBatch:
                key = batch.select(["doc_id", "page_no"]).take(pa.array(own, pa.int64()))  # noqa: B023  called at once
                return pa.RecordBatch.from_arrays([*key.columns, pa.array(number, pa.int32()), pa.array([len(p) for p in parts], pa.int64()), pa.array(parts, pa.string())], names=["doc_id", "page_no", "piece", "chars", "text"])  # noqa: B023

            for r in range(batch.num_rows):
                text = batch.column("text")[r].as_py()
                for k, i in enumerate(range(0, len(text), block)):
                    own.append(r)
                    number.append(k)
                    parts.append(text[i : i + block])
                    chars += len(parts[-1])
                    if chars >= _BATCH_CHARS:
                        yield made()
                        own, number, parts, chars = [], [], [], 0
            if own:
                yield made()

    clean = pages.where("doc_id is not null").select("doc_id", "page_no", normalize_text(F.col("text")).alias("text")).where("text <> ''")
    return written(clean.mapInArrow(cut_up, schema), "pieces")


def _blocks(pages: DataFrame, size: int, block: int) -> DataFrame:
    """(doc_id, block, own, text): blocks of the joined texts of normalised non-empty pages, each with ``size`` characters that follow."""
    return _blocks_of(_pieces(pages, block), size, block)


def _blocks_of(pieces: DataFrame, size: int, block: int) -> DataFrame:
    # places come from the pieces' lengths alone: a line feed stands between pages
    order = Window.partitionBy("doc_id").orderBy("page_no", "piece")
    lengths = pieces.select("doc_id", "page_no", "piece", "chars").withColumn("more", F.when((F.col("piece") == 0) & (F.row_number().over(order) > 1), 1).otherwise(0))
    places = lengths.withColumn("at", F.sum(F.col("chars") + F.col("more")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars") - F.col("more"))
    d = pieces.join(places.select("doc_id", "page_no", "piece", "more", "at"), ["doc_id", "page_no", "piece"])
    whole = d.select("doc_id", "at", F.when(F.col("more") == 1, F.concat(F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"))
    end = F.col("at") + F.length("text")
    first, last = F.greatest(F.floor((F.col("at") - size) / block), F.lit(0)), F.floor((end - 1) / block)
    d = whole.withColumns({"block": F.explode(F.sequence(first, last))})
    low, high = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.length("text"), (F.col("block") + 1) * block + size)
    d = d.select("doc_id", "block", low.alias("at"), F.substring("text", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("text")).where("text <> ''")
    d = d.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))
    text = F.array_join(F.col("x.text"), "")
    # a block that holds only what the one before looks ahead to can't be: its own part comes first
    return d.select("doc_id", "block", F.least(F.length(text), F.lit(block)).alias("own"), text.alias("text"))


def _group_exits(tables: DataFrame) -> DataFrame:
    """doc_id, part, table: the exits of whole groups of blocks, by entry into their first."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        at = None
        for blob in rows["table"].to_pylist():
            table = np.frombuffer(blob, np.int32)
            # a chain that ended stays so
            at = table if at is None else np.where((at < 0) | (at >= len(table)), _LAST, table[np.clip(at, 0, len(table) - 1)])
        return pa.table({"doc_id": rows["doc_id"].slice(0, 1), "part": rows["part"].slice(0, 1), "table": pa.array([at.astype(np.int32).tobytes()], pa.binary())})

    return tables.groupBy("doc_id", "part").applyInArrow(run, tables.select("doc_id", "part", "table").schema)


def _entries(tables: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, name, entry: where the chain enters each row of a group of tables(by, name, table, enter), in the order of name; rows behind its end are left out."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(name)
        at, out = rows["enter"][0].as_py(), []
        for blob in rows["table"].to_pylist():
            out.append(at if at >= 0 else None)
            table = np.frombuffer(blob, np.int32)
            # without overlap a chain may end right at the end of the text
            at = int(table[at]) if 0 <= at < len(table) else _LAST
        entry = pa.array(out, pa.int32())
        return pa.table({c: rows[c] for c in [*by, name]} | {"entry": entry}).filter(entry.is_valid())

    return tables.groupBy(*by).applyInArrow(run, tables.select(*by, name, F.col("enter").alias("entry")).schema)


def _cut(profile: Profile, block: int):
    size, overlap = profile.chunk_size, profile.overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                key = batch.slice(r, 1)
                text, own, entry = (key.column(c)[0].as_py() for c in ("text", "own", "entry"))
                found, at = [], entry
                for start, end in cut(text, size, overlap, entry):
                    if start >= own:
                        break
                    found.append((start, end))
                    at = next_start(start, end, overlap)
                else:
                    # the text ends before another full chunk: its tail, if that begins here
                    if at < own:
                        found.append((at, len(text)))
                first = key.column("block")[0].as_py() * block
                rows = [(a + first, b + first, t) for a, b in found if (t := text[a:b].strip())]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([key.column("doc_id")] * n) if n else key.column("doc_id").slice(0, 0), pa.array([key.column("block")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32())] + [pa.array(c, t) for c, t in zip(zip(*rows) if n else ((), (), ()), (pa.int64(), pa.int64(), pa.string()))],
                    names=["doc_id", "block", "place", "start", "end", "chunk_text"],
                )

    return run


def chunk_long_pages(pages: DataFrame, profile: Profile, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(doc_id, chunk_id, chunk_text, start, end) as ``chunk_pages`` gives them, however long a document is; a page is one task's work to normalise only.

    pages(doc_id, page_no, text), one row for each page.  Null and blank pages count for
    nothing, pages without a doc_id are left out.
    """
    if block < profile.chunk_size:
        raise ValueError("a block must hold a whole chunk")
    bounded_batches(pages.sparkSession)
    pieces = _pieces(pages, block)
    # a line feed stands between pages
    chars = F.sum(F.col("chars") + F.when(F.col("piece") == 0, 1).otherwise(0)) - 1
    several = written(pieces.groupBy("doc_id").agg(chars.alias("chars")).where(F.col("chars") > block).select("doc_id"), "long-documents")
    long = _chunk_blocks(_blocks_of(pieces.join(several, "doc_id", "left_semi"), profile.chunk_size, block), profile, block, group)
    return long.unionAll(_chunk_short(pieces.join(several, "doc_id", "left_anti"), profile))


def _chunk_short(pieces: DataFrame, profile: Profile) -> DataFrame:
    """Chunks of documents whose text fits into one block."""
    text = F.array_join(F.array_sort(F.collect_list(F.struct("page_no", "piece", "text")))["text"], "\n")
    d = pieces.groupBy("doc_id").agg(text.alias("text"))
    out = d.select("doc_id", F.posexplode_outer(chunks_of_texts(profile)("text")).alias("chunk_id", "c")).where("c is not null")
    return out.select("doc_id", F.col("chunk_id").cast("int").alias("chunk_id"), "c.chunk_text", F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end"))


def _chunk_blocks(blocks: DataFrame, profile: Profile, block: int, group: int) -> DataFrame:
    """Chunks of the documents of ``_blocks``, chained over their blocks."""
    size, overlap = profile.chunk_size, profile.overlap
    blocks = written(blocks, "blocks")
    table = F.arrow_udf(_tables(size, overlap), "binary")("text", "own")
    tables = blocks.select("doc_id", "block", F.floor(F.col("block") / group).alias("part"), table.alias("table"))
    groups = _entries(_group_exits(tables).withColumn("enter", F.lit(0)), ["doc_id"], "part")
    within = tables.join(groups.withColumnRenamed("entry", "enter"), ["doc_id", "part"])
    entries = _entries(within, ["doc_id", "part"], "block").drop("part")
    ready = blocks.join(entries, ["doc_id", "block"])
    schema = ready.select("doc_id", "block").withColumns({"place": F.lit(0), "start": F.lit(0).cast("long"), "end": F.lit(0).cast("long"), "chunk_text": F.lit("")}).schema
    found = written(ready.mapInArrow(_cut(profile, block), schema), "long-chunks")
    # running numbers by the counts of the blocks before, so that no task numbers a whole document
    counts = found.groupBy("doc_id", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = found.join(counts.select("doc_id", "block", before.alias("before")), ["doc_id", "block"])
    return d.select("doc_id", (F.col("before") + F.col("place")).cast("int").alias("chunk_id"), "chunk_text", "start", "end")


def _tables(size: int, overlap: int):
    def tables(text: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array([exits(t.as_py(), n.as_py(), size, overlap).tobytes() for t, n in zip(text, own)], pa.binary())

    return tables
