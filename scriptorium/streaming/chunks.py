"""Chunks of documents whose pages arrive as a stream.

State of a document: the text not yet emitted in a chunk, the next chunk id, the
next page number, and pages that came before their turn.  Pages are taken in the
order of page_no from 0; a gap holds later pages back until it is filled.  The
page with ``is_last`` ends its document: the tail is emitted, and only a mark stays
that turns later pages away.  With ``idle_s``, for streams that never end, a document
without news for so many seconds is ended as it is, the pages behind a gap included,
and its state or mark goes.  Each page is normalised on its own, as in the batch form.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Profile
from ..functions.text import normalize_text
from ..operators.chunking import cut, next_start

OUTPUT = "doc_id long, chunk_id int, chunk_text string"


def advance(state: dict, pages: list[tuple[int, str, bool]], size: int, overlap: int) -> list[tuple[int, str]]:
    """Take pages (page_no, text, is_last) into a state; the chunks that are complete.  A done state takes none."""
    if state["done"]:
        return []
    out: list[tuple[int, str]] = []

    def emit(text: str) -> None:
        if text := text.strip():
            out.append((state["chunk"], text))
            state["chunk"] += 1

    for number, text, last in pages:
        state["waiting"][str(number)] = [text, last]
    while (page := state["waiting"].pop(str(state["page"]), None)) is not None:
        state["page"] += 1
        if page[0]:
            state["buffer"] += ("\n" if state["buffer"] else "") + page[0]
        at = 0
        for start, end in cut(state["buffer"], size, overlap):
            emit(state["buffer"][start:end])
            at = next_start(start, end, overlap)
        state["buffer"] = state["buffer"][at:]
        if page[1]:
            emit(state["buffer"])
            state["done"] = True
            break
    return out


def finish(state: dict, size: int, overlap: int) -> list[tuple[int, str]]:
    """End a document whose last page never came: the pages behind gaps in order, then the tail."""
    numbers = sorted(map(int, state["waiting"]))
    out: list[tuple[int, str]] = []
    if not state["done"]:
        for number in numbers:
            state["page"] = number
            out += advance(state, [], size, overlap)
        out += advance(state, [(state["page"], "", True)], size, overlap)
    return out


def stream_chunks(pages: DataFrame, profile: Profile, idle_s: int | None = None) -> DataFrame:
    """pages(doc_id, page_no, text, is_last), streaming, to (doc_id, chunk_id, chunk_text)."""
    size, overlap = profile.chunk_size, profile.overlap

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            chunks = finish(json.loads(held.get[0]), size, overlap)
            held.remove()
            yield pd.DataFrame({"doc_id": key[0], "chunk_id": [c for c, _ in chunks], "chunk_text": [t for _, t in chunks]})
            return
        state = json.loads(held.get[0]) if held.exists else {"buffer": "", "chunk": 0, "page": 0, "waiting": {}, "done": False}
        arrived = [(int(n), t or "", bool(e)) for f in frames for n, t, e in zip(f["page_no"], f["text"], f["is_last"])]
        chunks = advance(state, arrived, size, overlap)
        if state["done"]:
            state |= {"buffer": "", "waiting": {}}
        held.update((json.dumps(state),))
        if idle_s is not None:
            held.setTimeoutDuration(1000 * idle_s)
        yield pd.DataFrame({"doc_id": key[0], "chunk_id": [c for c, _ in chunks], "chunk_text": [t for _, t in chunks]})

    clean = pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), normalize_text(F.coalesce("text", F.lit(""))).alias("text"), "is_last")
    return clean.groupBy("doc_id").applyInPandasWithState(step, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.ProcessingTimeTimeout)
