"""Sequence packing by order-preserving dynamic programming.

The token stream of a partition (documents in their stored order, each followed
by one end id) is cut into windows of at most ``SEQUENCE_TOKENS``.  A cut may be
made at a document end (free), at a sentence end, or - where a stretch offers
neither - at a fixed stride.  The cost of a window is its padding plus the
truncation penalty of the cut that ends it:

    f(j) = penalty(j) + min over i of  f(i) + SEQUENCE_TOKENS - (pos_j - pos_i)

over all i with pos_j - pos_i <= SEQUENCE_TOKENS.  As f(i) + pos_i does not
depend on j, the minimum is a sliding-window minimum, kept by a monotone queue
in amortised constant time a boundary.

One pass, no shuffle; a task holds one block of tokens and one document.  Rows
depend on the partition's content and number only, so a task that is run again
gives the same rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .storage import bounded_batches, tidy
from .wordhash import slices

SEQUENCE_TOKENS = 1024
END_ID = 0
SENTENCE_PENALTY = 4
STRIDE_PENALTY = 48
STRIDE = 64
BLOCK_TOKENS = 1 << 18
#: Fixed value: how the byte-level pre-tokeniser splits.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the unit cache of a worker; it is emptied when full and when a task ends.
CACHE_UNITS = 1_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its own character, the others as those from 256 on, in order."""
    plain = {b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_coders: dict[str, UnitTokenizer] = {}


def coder_of(path: str) -> UnitTokenizer:
    """One for each worker process and vocabulary."""
    if path not in _coders:
        _coders[path] = UnitTokenizer(path)
    return _coders[path]


class UnitTokenizer:
    """Token ids of whole texts, with each distinct blank-led unit encoded once.

    The vocabulary file is that of a byte-level BPE for ``tokenizers``; its ids
    come from the same merges run by ``tiktoken``, which is several times faster
    (a test holds both against each other).  As there, an added token of the
    vocabulary that stands in a text has its own id and cuts the text around it.

    The byte-level pre-tokeniser never joins a blank that has a non-blank after
    it with what stands before, so a text may be cut before each such blank.
    A text with a blank before other white space, or a last blank, is encoded whole.
    """

    _unsafe = re.compile(r" \s| \Z")

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
        if any(t.get(k) for t in model.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take blanks or whole words only are not supported")
        # the longest of those that start at one place
        self._added = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        byte_of = _byte_of_letter()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.added}
        # a byte-level vocabulary is numbered in the order of its merges, so ids are ranks
        self.coder = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.sentence_end = np.zeros(max([*ranks.values(), *self.added.values()]) + 1, dtype=bool)
        self.sentence_end[[i for token, i in ranks.items() if token[-1:] in (b".", b"!", b"?", b"\n")]] = True
        self.id_bytes = np.zeros(len(self.sentence_end), np.int64)
        self.id_bytes[list(ranks.values())] = [len(token) for token in ranks]
        self.clear()

    def clear(self) -> None:
        self.led: dict[str, int] = {}  # units after a blank, without it
        self.first: dict[str, int] = {}  # units that start a text
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)  # unit k has the ids from ends[k] to ends[k + 1]

    def _keep(self, index: dict[str, int], units: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        known, used = len(self.ends) - 1, int(self.ends[-1])
        index.update(zip(units, range(known, known + len(units))))
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (used + len(ids)))
        self.ids[used : used + len(ids)] = ids
        self.ends = np.append(self.ends, used + ends)

    def _learn(self, units: list[str]) -> None:
        """Encode new blank-led units in one text; the ids' byte lengths tell where each ends."""
        fresh = [u for u in units if u not in self.led]
        if fresh:
            ids = np.array(self.coder.encode_ordinary(" " + " ".join(fresh)), np.uint32)
            bytes_to = np.cumsum([len(u.encode()) + 1 for u in fresh])
            self._keep(self.led, fresh, ids, np.searchsorted(np.cumsum(self.id_bytes[ids]), bytes_to) + 1)

    def _first(self, unit: str) -> int:
        if unit not in self.first:
            ids = np.array(self.coder.encode_ordinary(unit), np.uint32)
            self._keep(self.first, [unit], ids, np.array([len(ids)]))
        return self.first[unit]

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text that may not be cut at blanks, or has added tokens."""
        out, at = [], 0
        for m in self._added.finditer(text):
            out += [*self.coder.encode_ordinary(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return np.array(out + self.coder.encode_ordinary(text[at:]), np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.led) + len(self.first) > CACHE_UNITS:
            self.clear()
        unsafe = [k for k, t in enumerate(texts) if self._unsafe.search(t) or any(a in t for a in self.added)]
        skip = set(unsafe)
        lists = pc.split_pattern(pa.array(["" if k in skip else t for k, t in enumerate(texts)], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        place, begins = coded.indices.to_numpy(), lists.offsets.to_numpy()
        led = np.ones(len(place), bool)
        led[begins[:-1]] = False
        used = np.unique(place[led])
        units = coded.dictionary.take(pa.array(used)).to_pylist()
        self._learn(units)
        unit_of = np.full(len(coded.dictionary), -1, np.int64)
        unit_of[used] = [self.led[u] for u in units]
        unit = unit_of[place]
        heads = coded.dictionary.take(pa.array(place[begins[:-1]])).to_pylist()
        unit[begins[:-1]] = [self._first(h) for h in heads]
        begin = self.ends[unit]
        size = self.ends[unit + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
        out = np.split(ids, total[begins[1:-1]])
        for k in unsafe:
            out[k] = self._whole(texts[k])
        return out


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cut positions (ascending, the last is len(ids)) and their penalties."""
    n = len(ids)
    penalty = np.full(n + 1, -1, dtype=np.int32)
    is_end = sentence_end[ids]
    cut = np.flatnonzero(is_end[:-1] & ~is_end[1:]) + 1
    penalty[cut] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[n] = 0
    known = np.concatenate([[0], np.flatnonzero(penalty[1:] >= 0) + 1])
    for a, gap in zip(known[:-1][(gaps := np.diff(known)) > STRIDE], gaps[gaps > STRIDE]):
        penalty[np.arange(a + STRIDE, a + gap, STRIDE)] = STRIDE_PENALTY
    position = np.flatnonzero(penalty[1:] >= 0) + 1
    return position, penalty[position]


def best_cuts(position: np.ndarray, penalty: np.ndarray, capacity: int = SEQUENCE_TOKENS) -> list[int]:
    """Cuts of least cost, the last position included; gaps must not exceed ``capacity``."""
    pos, pen = [0, *position.tolist()], [0, *penalty.tolist()]
    n = len(pos)
    key = [0] * n  # f(i) + pos_i
    back = [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - capacity:
            queue.popleft()
        i = queue[0]
        back[j] = i
        k = key[j] = key[i] + capacity + pen[j]  # f(j) + pos_j
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts = []
    j = n - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs one partition's stream of documents, block by block."""

    def __init__(self, sentence_end: np.ndarray, first_sequence: int):
        self.sentence_end = sentence_end
        self.sequence = first_sequence
        self.parts: list[tuple[int, int, int, np.ndarray]] = []  # doc_id, start, tokens of the document, ids
        self.size = 0

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[dict[str, list]]:
        ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
        for at in range(0, len(ids), BLOCK_TOKENS):
            piece = ids[at : at + BLOCK_TOKENS]
            self.parts.append((doc_id, at, len(ids), piece))
            self.size += len(piece)
            if self.size >= BLOCK_TOKENS:
                yield self._pack(last=False)

    def finish(self) -> Iterator[dict[str, list]]:
        if self.parts:
            yield self._pack(last=True)

    def _pack(self, last: bool) -> dict[str, list]:
        ids = np.concatenate([p[3] for p in self.parts])
        begins = np.concatenate([[0], np.cumsum([len(p[3]) for p in self.parts])])
        whole = np.array([p[1] + len(p[3]) == p[2] for p in self.parts])
        cuts = best_cuts(*boundaries(ids, begins[1:][whole], self.sentence_end))
        if not last:
            cuts = cuts[:-1]
        out: dict[str, list] = {n: [] for n in _ARROW.names}
        part, low = 0, 0
        for high in cuts:
            at = low
            while at < high:
                doc, start, tokens, own = self.parts[part]
                end = min(int(begins[part + 1]), high)
                inner = at - int(begins[part])
                values = (doc, start + inner, end - at, zlib.crc32(own[inner : inner + end - at].tobytes()), tokens, self.sequence, at - low)
                for name, v in zip(_ARROW.names, values):
                    out[name].append(v)
                at = end
                if at == begins[part + 1]:
                    part += 1
            self.sequence += 1
            low = high
        rest = []
        for k in range(part, len(self.parts)):
            doc, start, tokens, own = self.parts[k]
            inner = max(0, low - int(begins[k]))
            rest.append((doc, start + inner, tokens, own[inner:]))
        self.parts, self.size = rest, len(ids) - low
        return out


def pack(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Pieces of the packed sequences of all documents.

    documents: doc_id long, text string; other columns are ignored.  Null text:
    empty, so its only token is the end id.  Repeated rows are packed each, in the
    stored order; of cuts of equal cost the earliest is taken.  A very long text
    spans blocks and sequences, each of its ids in one piece.  An empty table gives
    no rows.  Sequences are gapless from offset 0; the last of each partition, and
    the last of a stream's block, may be short.
    """
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer_path)
        packer = Packer(coder.sentence_end, TaskContext.get().partitionId() << 36)
        batch_of = lambda rows: pa.RecordBatch.from_pydict(rows, schema=_ARROW)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts)):
                for rows in packer.add(doc_id, ids):
                    yield batch_of(rows)
        for rows in packer.finish():
            yield batch_of(rows)
        coder.clear()

    return documents.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)
