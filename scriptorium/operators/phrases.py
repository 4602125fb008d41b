"""Phrases of a dictionary replaced, the longest one at the leftmost place.

The dictionary is a trie in flat arrays: children of the root by code point, all
other transitions as sorted keys of (state, code point), and the phrase that ends
in a state.  A batch of texts is one array of code points; all of its places walk
the trie together, a level at a time, and only those still inside some phrase go
on.  So the work follows the text and the phrases met in it, not the dictionary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded_batches

#: A dictionary is sent to every worker, so its tables have a bound.
MAX_TABLE_BYTES = 256 << 20
#: Code points of texts that walk the trie together, at least one text.
BATCH_CHARS = 1 << 21
#: Between texts; no phrase holds it.
_BORDER = np.uint32(0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PhraseTable:
    """Flat trie of phrases; an empty phrase stands nowhere."""

    def __init__(self, phrases: dict[str, str]):
        phrases = {k: v for k, v in phrases.items() if k}
        self.targets = list(phrases.values())
        size = np.array([len(k) for k in phrases], np.int64)
        points = _points("".join(phrases)).astype(np.int64)
        begin = np.cumsum(size) - size
        state, keys, ends = np.zeros(len(size), np.int64), [], [np.full(1, -1, np.int64)]
        states = 1
        for level in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > level)
            own, which = np.unique(state[on] << 21 | points[begin[on] + level], return_inverse=True)
            state[on] = which + states
            states += len(own)
            keys.append(own)
            end = np.full(len(own), -1, np.int64)
            last = on[size[on] == level + 1]
            end[state[last] - states + len(own)] = last
            ends.append(end)
        # states are numbered in the order of their keys, so a key's place is its state
        self.keys = np.concatenate([np.zeros(0, np.int64), *keys])
        self.ends = np.concatenate(ends)
        self.root = np.zeros(0x110001, np.int32)
        first = keys[0] if keys else self.keys
        self.root[first] = np.arange(1, len(first) + 1)
        if self.nbytes > MAX_TABLE_BYTES:
            raise ValueError(f"{len(phrases)} phrases take {self.nbytes} bytes on every worker; the bound is {MAX_TABLE_BYTES}")

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.ends.nbytes + self.root.nbytes + sum(map(len, self.targets)) * 4

    def longest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where a phrase stands, the longest one's length, and its number."""
        state = self.root[points]
        at = np.flatnonzero(state)
        state, size, found = state[at].astype(np.int64), np.zeros(len(points), np.int32), np.full(len(points), -1, np.int64)
        level = 1
        while len(at):
            end = self.ends[state]
            hit = end >= 0
            size[at[hit]], found[at[hit]] = level, end[hit]
            on = at + level < len(points)
            at, state = at[on], state[on]
            key = state << 21 | points[at + level]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[place] == key
            at, state = at[on], place[on] + 1
            level += 1
        places = np.flatnonzero(size)
        return places, size[places], found[places]

    def taken(self, text: str) -> list[dict]:
        """at, size, replacement of the phrases that are replaced in a text, from the left."""
        return [{"at": at, "size": size, "replacement": self.targets[k]} for at, size, k in zip(*(x.tolist() for x in self.places(text)))]

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``taken`` as columns: at, size and the phrase's number."""
        places, sizes, found = self.longest(_points(text))
        after, own, k = np.searchsorted(places, places + sizes).tolist(), [], 0
        while k < len(places):
            own.append(k)
            k = after[k]
        return places[own], sizes[own], found[own]

    def _converted(self, texts: list[str]) -> list[str]:
        whole = np.concatenate([x for t in texts for x in (_points(t), [_BORDER])]).astype(np.uint32)
        places, sizes, found = self.longest(whole)
        after = np.searchsorted(places, places + sizes).tolist()
        places, sizes, found = places.tolist(), sizes.tolist(), found.tolist()
        out, k, first = [], 0, 0
        for text in texts:
            parts, at = [], 0
            while k < len(places) and places[k] < first + len(text):
                place = places[k] - first
                parts += [text[at:place], self.targets[found[k]]]
                at = place + sizes[k]
                k = after[k]
            out.append("".join([*parts, text[at:]]) if parts else text)
            first += len(text) + 1
        return out

    def convert(self, texts: list[str | None]) -> list[str | None]:
        """Each text with its phrases replaced; null stays null."""
        out, held, chars = list(texts), [], 0
        for i, t in enumerate([*texts, None]):
            if t:
                held.append(i)
                chars += len(t)
            if held and (chars >= BATCH_CHARS or i == len(texts)):
                for k, new in zip(held, self._converted([texts[k] for k in held])):
                    out[k] = new
                held, chars = [], 0
        return out


def phrase_dictionary(rows: DataFrame, phrase: str = "phrase", replacement: str = "replacement") -> dict[str, str]:
    """A dictionary from a table; of several replacements the least, rows with a null are left out.  Its characters are counted before it is read."""
    d = rows.select(F.col(phrase).alias("p"), F.col(replacement).alias("r")).where("p is not null and r is not null").groupBy("p").agg(F.min("r").alias("r"))
    chars = d.agg(F.sum(F.length("p") + F.length("r"))).first()[0] or 0
    if 4 * chars > MAX_TABLE_BYTES:
        raise ValueError(f"a dictionary of {chars} characters takes {4 * chars} bytes or more on every worker; the bound is {MAX_TABLE_BYTES}")
    return {r.p: r.r for r in d.toLocalIterator()}


def _shared(rows: DataFrame, phrases: dict[str, str] | DataFrame):
    bounded_batches(rows.sparkSession)
    table = PhraseTable(phrase_dictionary(phrases) if isinstance(phrases, DataFrame) else phrases)
    return rows.sparkSession.sparkContext.broadcast(table)


def find_phrases(rows: DataFrame, phrases: dict[str, str] | DataFrame, name: str, text: str = "text") -> DataFrame:
    """rows with ``name``: array of at (from 0), size, replacement of the phrases that ``convert_phrases`` replaces in ``text``; empty for null."""
    shared = _shared(rows, phrases)
    empty = [np.zeros(0, np.int64)] * 3

    @F.arrow_udf("array<struct<at:long,size:long,replacement:string>>")
    def found(x: pa.Array) -> pa.Array:
        each = [shared.value.places(t.as_py()) if t.is_valid else empty for t in x]
        offsets = np.concatenate([[0], np.cumsum([len(at) for at, _, _ in each])]).astype(np.int32)
        at, size, number = (np.concatenate([empty[0], *column]).astype(np.int64) for column in (zip(*each) if each else [[]] * 3))
        names = pa.array([shared.value.targets[k] for k in number.tolist()], pa.string())
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(at), pa.array(size), names], names=["at", "size", "replacement"]))

    return rows.withColumn(name, found(text))


def convert_phrases(examples: DataFrame, phrases: dict[str, str] | DataFrame, columns: tuple[str, ...] = ("input", "output")) -> DataFrame:
    """The longest phrase of a dictionary (or a table of phrase, replacement) at each place replaced, in the given columns that exist."""
    shared = _shared(examples, phrases)

    @F.arrow_udf("string")
    def converted(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.convert(x.to_pylist()), pa.string())

    return examples.withColumns({c: converted(c) for c in columns if c in examples.columns})


def convert_records(lines: DataFrame, phrases: dict[str, str] | DataFrame, columns: tuple[str, ...] = ("input", "output")) -> DataFrame:
    """Lines (value) of JSON objects with phrases replaced in the named text fields; all other fields, and their order, as they were.  Lines that are no object are left out."""
    from .parsing import storable, strict_object

    shared = _shared(lines, phrases)

    @F.arrow_udf("string")
    def converted(x: pa.Array) -> pa.Array:
        import json

        found = [strict_object(line) for line in x.to_pylist()]
        fields = [(r, c) for r in found if r is not None for c in columns if isinstance(r.get(c), str)]
        for (r, c), text in zip(fields, shared.value.convert([r[c] for r, c in fields])):
            r[c] = text
        return pa.array([None if r is None else storable(json.dumps(r, ensure_ascii=False)) for r in found], pa.string())

    return lines.select(converted("value").alias("value")).where("value is not null")
