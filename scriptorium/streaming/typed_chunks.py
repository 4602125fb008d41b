"""Chunks of streamed documents with typed state, as ``chunks.stream_chunks`` gives them.

State of a document: its counters and the text that no chunk holds yet, which is
shorter than a chunk and a page; and a map of the pages that wait behind a gap, each an
entry of its own, so that a page that arrives is one write however many wait.  A
document that ended keeps only a mark that turns late pages away, which with ``keep_s``
expires by itself.  With ``idle_s`` a timer ends a document without news.  State lives
in RocksDB (``rocksdb``), as typed state asks for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Profile
from ..functions.text import normalize_text
from .chunks import OUTPUT, advance, finish

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Waiting:
    """The map of waiting pages with the few methods of a dict that cutting needs."""

    def __init__(self, held):
        self.held = held

    def __setitem__(self, number: str, page: list) -> None:
        self.held.updateValue((int(number),), tuple(page))

    def __iter__(self) -> Iterator[str]:
        return iter([str(k[0]) for k in self.held.keys()])

    def pop(self, number: str, default=None):
        if not self.held.containsKey((int(number),)):
            return default
        page = self.held.getValue((int(number),))
        self.held.removeKey((int(number),))
        return page


class ChunkProcessor(StatefulProcessor):
    def __init__(self, profile: Profile, idle_s: int | None, keep_s: int | None):
        self.size, self.overlap, self.idle_s, self.keep_s = profile.chunk_size, profile.overlap, idle_s, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "page int, chunk int, buffer string")
        self.waiting = handle.getMapState("waiting", "page_no int", "text string, is_last boolean")
        self.closed = handle.getValueState("closed", "done boolean", None if self.keep_s is None else 1000 * self.keep_s)

    def _state(self) -> dict:
        page, chunk, buffer = self.open.get() if self.open.exists() else (0, 0, "")
        return {"page": page, "chunk": chunk, "buffer": buffer, "done": False, "waiting": _Waiting(self.waiting)}

    def _end(self) -> None:
        self.open.clear()
        self.waiting.clear()
        self.closed.update((True,))

    def _timers(self) -> list[int]:
        return list(self.handle.listTimers())

    @staticmethod
    def _rows(key, chunks: list[tuple[int, str]]) -> pd.DataFrame:
        # plain object columns: struct rows can't be made of pandas' own string arrays
        ids, texts = [c for c, _ in chunks], [t for _, t in chunks]
        return pd.DataFrame({"doc_id": pd.Series([key[0]] * len(ids), dtype="int64"), "chunk_id": pd.Series(ids, dtype="int32"), "chunk_text": pd.Series(texts, dtype=object)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = [(int(n), t or "", bool(e)) for f in rows for n, t, e in zip(f["page_no"], f["text"], f["is_last"])]
        if self.closed.exists():
            return
        state = self._state()
        chunks = advance(state, arrived, self.size, self.overlap)
        if state["done"]:
            self._end()
        else:
            self.open.update((state["page"], state["chunk"], state["buffer"]))
        if self.idle_s is not None:
            for t in self._timers():
                self.handle.deleteTimer(t)
            if not state["done"]:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle_s)
        yield self._rows(key, chunks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            chunks = finish(self._state(), self.size, self.overlap)
            self._end()
            yield self._rows(key, chunks)

    def close(self) -> None:
        pass


def stream_chunks_typed(pages: DataFrame, profile: Profile, idle_s: int | None = None, keep_s: int | None = None) -> DataFrame:
    """pages(doc_id, page_no, text, is_last), streaming, to (doc_id, chunk_id, chunk_text); start it inside ``rocksdb``.

    Pages are taken in the order of page_no from 0; a repeated page that still waits is
    replaced, one that was taken is ignored.  Null text is an empty page.  With ``idle_s``
    or ``keep_s`` run it by a processing-time trigger: where timers may still come, one
    for what is there now does not end.
    """
    clean = pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), normalize_text(F.coalesce("text", F.lit(""))).alias("text"), "is_last")
    timed = "None" if idle_s is None and keep_s is None else "ProcessingTime"
    return clean.groupBy("doc_id").transformWithStateInPandas(ChunkProcessor(profile, idle_s, keep_s), OUTPUT, "Append", timed)
