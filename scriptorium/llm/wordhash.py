"""Vectorised word hashing over Arrow text columns.

A word is a maximal run of bytes outside space and 0x09-0x0D (all other white
space of Unicode is inside words).  Hashing runs over the raw UTF-8 buffer in
bounded segments, so neither many documents nor one very long document needs
memory beyond its own bytes plus a constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RAND = np.random.default_rng(7_041_776).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RAND_LOWER = _RAND[_LOWER]
#: Character classes of word shapes: letters fold to a or A (bytes over 127 to a), digits to 0.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    """``_BASE`` to the powers 0..n-1 modulo 2**64, grown on demand."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        out = np.full(size, np.uint64(_BASE), dtype=np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SEGMENT_BYTES that cut no word."""
    at, total = 0, len(data)
    while at < total:
        end = min(at + SEGMENT_BYTES, total)
        if end < total:
            boundary = offsets[np.searchsorted(offsets, end, "right") - 1]
            if boundary > at:
                end = int(boundary)
            else:  # inside one long document: cut at its last white space, or let the word end
                while True:
                    gaps = np.flatnonzero(_SPACE[data[at:end]])
                    limit = int(offsets[np.searchsorted(offsets, at, "right")])
                    if len(gaps) and gaps[-1] > 0:
                        end = at + int(gaps[-1])
                        break
                    if end >= limit:
                        end = limit
                        break
                    end = min(2 * end - at, limit)
        yield at, end
        at = end


def hash_words(column: pa.Array, lower: bool = True, shapes: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words in order, and word offsets per document (n + 1).

    ``lower`` folds A-Z only.  ``shapes`` adds a third array: hashes of the words'
    shapes, which are their character classes with runs collapsed (``Aa,`` for ``Word,``).
    """
    data, offsets = text_buffer(column)
    table = _RAND_LOWER if lower else _RAND
    hashes, starts, forms = [], [], []
    for at, end in _segments(data, offsets):
        b = data[at:end]
        inside = ~_SPACE[b]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        docs = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        first[docs] = inside[docs]
        begin = np.flatnonzero(first)
        if not len(begin):
            continue
        value = table[b]
        value *= inside
        local = np.arange(begin[0], len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b))))
        last = np.diff(np.append(begin, len(b)))
        value = value[begin[0] :] * _power_table(int(last.max()))[local]
        hashes.append(np.add.reduceat(value, begin - begin[0]))
        starts.append(begin + at)
        if shapes:
            kind = _CLASS[b]
            kept = first.copy()
            kept[1:] |= inside[1:] & (kind[1:] != kind[:-1])
            place = np.flatnonzero(kept)
            own = np.cumsum(kept)[begin] - 1  # of each word's first kept byte
            size = np.diff(np.append(own, len(place)))
            local = np.arange(len(place)) - np.repeat(own, size)
            forms.append(np.add.reduceat(_RAND[kind[place]] * _power_table(int(size.max()))[local], own))
    if not hashes:
        return (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)) + (np.zeros(0, np.uint64),) * shapes
    words, position = mix64(np.concatenate(hashes)), np.concatenate(starts)
    out = words, np.searchsorted(position, offsets).astype(np.int64)
    return (*out, mix64(np.concatenate(forms) + np.uint64(1))) if shapes else out


def windows(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows, and their offsets per document.

    A document of 1 to ``size`` - 1 words has one window, its whole sequence; one
    without words has none.
    """
    lengths = np.diff(offsets)
    count = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    total = int(out_offsets[-1])
    doc = np.repeat(np.arange(len(lengths)), count)
    begin = offsets[:-1][doc] + np.arange(total) - out_offsets[:-1][doc]
    left = np.minimum(lengths[doc], size)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    h = np.zeros(total, np.uint64)
    for k in range(size):
        h = np.where(k < left, mix64(h * np.uint64(_BASE) + padded[begin + k] + np.uint64(k + 1)), h)
    return h, out_offsets


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` text bytes, one row at least."""
    for batch in batches:
        text = batch.column(column)
        if not batch.num_rows:
            continue
        sizes = np.diff(text_buffer(text)[1])
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right"))
            end = max(end, at + 1)
            yield batch.slice(at, end - at)
            at = end
