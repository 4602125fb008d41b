"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Levels: words; pairs under their first word; triples under their pair.  Every
n-gram of the training texts is in it.  A level is a set of files, each a range
of (context, successor) in order:

- monotone pointers from contexts to their successors, in Elias-Fano form;
- the successors, in as few bits as the file's largest needs: of a word the next
  word's id; of a pair (u, v) the place of w among the successors of v, which is a
  small number and leads to the pair (v, w) at once;
- smoothed probabilities and back-off weights, logarithms in 16 bits.

Workers map the files into memory; a query finds its context's slice by two
pointers and its successor by search in that slice.  Probabilities are
interpolated with absolute discounting:

    p(w | h) = (c(h, w) - D) / c(h) + g(h) * p(w | shorter h),
    g(h) = D * (distinct w after h) / c(h)

Counting: counts of the level below say how many tokens stand under each
context, so the ranges are cut beforehand to about equal numbers of tokens, a
context with more than its share among its successors.  Tasks sort what they
see, sum it, and send compressed blocks by range; a range is merged in one task and
becomes one file.  All levels grow with the corpus; no task or driver holds one.
The driver holds a few numbers a file, of which a level has ``MAX_PARTS`` at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, materialise, new_path, release
from .trie_files import EliasFano, bits_at, open_arrays, pack_bits, write_arrays
from .wordhash import hash_words, slices

DISCOUNT = 0.75
#: Tokens under a file's contexts, as far as MAX_PARTS files hold them.
PART_TOKENS = 2_000_000
MAX_PARTS = 1 << 16
#: N-grams that a task sums before it sends them, tokens that it asks at once, words a file.
FLUSH, ASKED, SHARD_WORDS = 2_000_000, 1_000_000, 2_000_000
#: Slices of more successors are searched one by one.
_LONG_SLICE = 512
#: Hash that stands for the end of a text.
_END = np.int64(-7_046_029_254_386_353_131)
#: Quantised log10 probabilities: steps of 1 / _STEPS from 0 down.
_STEPS = 4096


def _quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * _STEPS), 0, 65535).astype(np.uint16)


def _restore(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / -_STEPS


def _changes(a: np.ndarray) -> np.ndarray:
    """Places where a value differs from the one before, the first included."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]))


def _sorted(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """The order by (major, minor)."""
    if len(major):
        low, width = int(minor.min()), int(minor.max()) - int(minor.min()) + 1
        base = int(major.min())
        if (int(major.max()) - base + 1) * width < 2**63:
            return np.argsort((major - base) * width + (minor - low))
    return np.lexsort((minor, major))


@dataclass
class Words:
    """The word files in order of their hashes, and the id of each one's first word."""

    uris: list[str] = field(default_factory=list)
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def __len__(self) -> int:
        return int(self.offsets[-1])

    @property
    def id_type(self) -> type:
        return np.int32 if len(self) < 2**31 else np.int64

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (-1: unknown) and counts."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        cuts = np.append(np.searchsorted(distinct, self.first), len(distinct))
        for k in np.flatnonzero(np.diff(cuts)):
            a, own = open_arrays(self.uris[k]), slice(cuts[k], cuts[k + 1])
            at = np.minimum(np.searchsorted(a["hash"], distinct[own]), len(a["hash"]) - 1)
            hit = a["hash"][at] == distinct[own]
            ids[own] = np.where(hit, self.offsets[k] + at, -1)
            counts[own] = np.where(hit, a["n"][at], 0)
        return ids[back], counts[back]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts by id; 0 of -1."""
        return _gather(self.uris, self.offsets, ids, lambda a, at: a["n"][at].astype(np.int64), np.int64)


def _gather(uris: list, offsets: np.ndarray, rows: np.ndarray, read, kind) -> np.ndarray:
    """read(file's arrays, local rows) at global rows, 0 at -1; the files are taken one after the other."""
    out = np.zeros(len(rows), kind)
    if not uris:
        return out
    order = np.argsort(rows) if len(uris) > 1 else np.arange(len(rows))
    at = rows[order]
    cuts = np.searchsorted(at, offsets) if len(uris) > 1 else np.array([0, len(at)])
    for k in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[k] : cuts[k + 1]]
        good = rows[own] >= 0
        if uris[k] is not None:
            out[own[good]] = read(open_arrays(uris[k]), rows[own[good]] - offsets[k])
    return out


@dataclass
class Level:
    """Files of a level: file k has the keys from (major[k], minor[k]) on and the rows from offsets[k] on.

    hot: contexts whose successors are dealt over files of their own; with the row of
    their first successor, their number of successors and back-off weight.
    """

    uris: list[str | None]
    major: np.ndarray
    minor: np.ndarray
    offsets: np.ndarray
    hot: np.ndarray
    hot_first: np.ndarray
    hot_types: np.ndarray
    hot_weight: np.ndarray

    def ask(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (-1: none), place among its context's successors (-1: none), and log10 probability or, of none, back-off weight.

        A context of -1 is unknown; a word of -1 is after no context.
        """
        n = len(context)
        asked = np.flatnonzero(context >= 0)
        c, w = context[asked], word[asked]
        order = _sorted(c, w)
        asked, c, w = asked[order], c[order], w[order]
        new = np.ones(len(c), bool)
        np.not_equal(c[1:], c[:-1], out=new[1:])
        new[1:] |= w[1:] != w[:-1]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(c)))
        out = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n)
        for x, got in zip(out, self._distinct(c[head], w[head])[:3]):
            x[asked] = np.repeat(got, size)
        return out

    def _distinct(self, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``ask`` for distinct keys in order; and the row of the contexts' first successors (-1: none)."""
        n = len(c)
        row, place, log, begin = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n), np.full(n, -1, np.int64)
        cuts = np.append(_cut_places(c, w, self.major, self.minor), n)
        for k in np.flatnonzero(np.diff(cuts)):
            if self.uris[k] is None:
                continue
            a, (x, y) = open_arrays(self.uris[k]), cuts[k : k + 2]
            local = c[x:y] - self.major[k]
            y = x + int(np.searchsorted(local, len(a["weight"])))  # later contexts have no successors
            local, word = local[: y - x], w[x:y]
            if not len(local):
                continue
            head = _changes(local)
            size = np.diff(np.append(head, len(local)))
            distinct = local[head]
            pointer = EliasFano(a, "pointer")
            low, high = pointer[distinct], pointer[distinct + 1]
            full = high > low
            log[x:y] = np.repeat(np.where(full, _restore(a["weight"][distinct]), 0.0), size)
            begin[x:y] = np.repeat(np.where(full, self.offsets[k] + low, -1), size)
            lo, first, end = np.repeat(low, size), np.repeat(low, size), np.repeat(high, size)
            words, bits = a["word"], int(a["bits"][0])
            hi = end.copy()
            # a long slice is searched by itself, once for all that is asked of it
            for j in np.flatnonzero((high - low > _LONG_SLICE) & (64 * size > high - low)):
                own = slice(head[j], head[j] + size[j])
                lo[own] += np.searchsorted(bits_at(words, bits, np.arange(low[j], high[j])), word[own])
                hi[own] = lo[own]
            # in the others the first successor that is not less, all slices at a time
            open_ = np.flatnonzero((lo < hi) & (word >= 0))
            low_, high_, asked = lo[open_], hi[open_], word[open_]
            while len(open_):
                middle = (low_ + high_) >> 1
                less = bits_at(words, bits, middle) < asked
                low_, high_ = np.where(less, middle + 1, low_), np.where(less, high_, middle)
                more = low_ < high_
                done = ~more
                lo[open_[done]] = low_[done]
                open_, low_, high_, asked = open_[more], low_[more], high_[more], asked[more]
            inner = np.flatnonzero((lo < end) & (word >= 0))
            hit = inner[bits_at(words, bits, lo[inner]) == word[inner]]
            row[x + hit] = self.offsets[k] + lo[hit]
            place[x + hit] = lo[hit] - first[hit]
            log[x + hit] = _restore(a["log"][lo[hit]])
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, c), len(self.hot) - 1)
            own = np.flatnonzero(self.hot[at] == c)
            at = at[own]
            begin[own] = self.hot_first[at]
            place[own] = np.where(row[own] >= 0, row[own] - begin[own], -1)
            log[own] = np.where(row[own] >= 0, log[own], self.hot_weight[at])
        return row, place, log, begin

    def logs(self, rows: np.ndarray) -> np.ndarray:
        return _gather(self.uris, self.offsets, rows, lambda a, at: _restore(a["log"][at]), np.float64)

    def successors(self, rows: np.ndarray) -> np.ndarray:
        return _gather(self.uris, self.offsets, rows, lambda a, at: bits_at(a["word"], int(a["bits"][0]), at), np.int64)

    def begins(self, context: np.ndarray) -> np.ndarray:
        """Row of the first successor of each context."""
        distinct, back = np.unique(context, return_inverse=True)
        return self._distinct(distinct, np.full(len(distinct), -1, np.int64))[3][back]

    def types(self, context: int) -> int:
        """Number of successors of one context."""
        at = int(np.searchsorted(self.hot, context))
        if at < len(self.hot) and self.hot[at] == context:
            return int(self.hot_types[at])
        k = int(np.searchsorted(self.major, context, "right")) - 1
        if k < 0 or self.uris[k] is None or context - self.major[k] >= len((a := open_arrays(self.uris[k]))["weight"]):
            return 0
        low, high = EliasFano(a, "pointer")[np.array([context, context + 1]) - self.major[k]]
        return int(high - low)


def _cut_places(major: np.ndarray, minor: np.ndarray, at_major: np.ndarray, at_minor: np.ndarray) -> np.ndarray:
    """The first of the sorted keys that is not before each cut."""
    out = np.searchsorted(major, at_major, "left")
    for k in np.flatnonzero(at_minor):
        end = int(np.searchsorted(major, at_major[k], "right"))
        out[k] += np.searchsorted(minor[out[k] : end], at_minor[k])
    return out


@dataclass
class Trie:
    """The levels built so far; picklable, opens its files where it is used."""

    words: Words = field(default_factory=Words)
    tokens: int = 0  # training tokens
    pairs: Level | None = None
    triples: Level | None = None

    def log_word(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (len(self.words) + 1)))

    def log_texts(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token after up to two tokens before it; first: where texts begin."""
        log = self.log_word(self.words.counts(ids))
        if self.pairs is None:
            return log
        context = np.where(first, -1, np.append(-1, ids[:-1]))
        row, place, own = self.pairs.ask(context, ids)
        log = np.where(row >= 0, own, own + log)
        if self.triples is None:
            return log
        context = np.where(first, -1, np.append(-1, row[:-1]))
        row, _, own = self.triples.ask(context, place)
        return np.where(row >= 0, own, own + log)


def _with_ends(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (words, then the end, of each text) as signed longs, and offsets."""
    words, offsets = hash_words(column)
    n = np.diff(offsets)
    out_offsets = offsets + np.arange(len(offsets))
    out = np.full(int(out_offsets[-1]), _END, np.int64)
    inner = np.ones(len(out), bool)
    inner[out_offsets[1:] - 1] = False
    out[inner] = words.view(np.int64)
    return out, out_offsets if len(n) else np.zeros(1, np.int64)


def _count_words(documents: DataFrame) -> DataFrame:
    flush_at = FLUSH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in kept])
            distinct, back = np.unique(keys, return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in kept])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n)], names=["hash", "n"])

        for batch in slices(batches):
            kept.append(np.unique(_with_ends(batch.column("text"))[0], return_counts=True))
            size += len(kept[-1][0])
            if size > flush_at:
                yield flush()
                kept, size = [], 0
        if kept:
            yield flush()

    return documents.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _cuts_of(n: np.ndarray, part_tokens: int) -> list[dict]:
    """Where ranges begin in rows with n tokens each: (row, j, of), at the j-th of ``of`` shares of a row's successors.

    A row of more than part_tokens has ranges of its own.
    """
    total = np.cumsum(n)
    out, used, at = [], 0, 0
    while at < len(n):
        out.append({"row": at, "j": 0, "of": 1})
        if n[at] > part_tokens:
            of = -(-int(n[at]) // part_tokens)
            out += [{"row": at, "j": j, "of": of} for j in range(1, of)]
            at += 1
        else:
            at = max(int(np.searchsorted(total, used + part_tokens, "right")), at + 1)
        used = int(total[at - 1])
    return out


_CUTS = "cuts array<struct<row:long,j:long,of:long>>"
_CUT_TYPE = pa.list_(pa.struct([("row", pa.int64()), ("j", pa.int64()), ("of", pa.int64())]))


def _write_words(counts: DataFrame, folder: str, part_tokens: int) -> tuple[Words, list]:
    """The word files, and the cuts of the pairs under them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            rows = pa.Table.from_batches(batches)
            h, n = rows["hash"].to_numpy(), rows["n"].to_numpy()
            uri = write_arrays(folder, {"hash": h, "n": n.astype(np.uint32 if n.max() < 2**32 else np.uint64)})
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array(h[:1]), pa.array([len(h)], pa.int64()), pa.array([_cuts_of(n, part_tokens)], _CUT_TYPE)], names=["uri", "first", "n", "cuts"])

    dealt = counts.repartitionByRange(max(1, -(-counts.count() // SHARD_WORDS)), "hash").sortWithinPartitions("hash")
    # written out, so that a lost executor's files are not told twice
    rows = sorted(materialise(dealt.mapInArrow(run, f"uri string, first long, n long, {_CUTS}"), "word-files").collect(), key=lambda r: r["first"])
    offsets = np.cumsum([0] + [r["n"] for r in rows]).astype(np.int64)
    return Words([r["uri"] for r in rows], np.array([r["first"] for r in rows], np.int64), offsets), _global_cuts(rows, offsets)


def _global_cuts(rows: list, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    return [(int(o) + c["row"], c["j"], c["of"]) for r, o in zip(rows, offsets) for c in r["cuts"]]


def _pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as differences and counts, byte planes compressed."""
    wide = len(n) and int(n.max()) >= 2**32
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + n.astype(np.uint64 if wide else np.uint32).view(np.uint8).reshape(-1, 8 if wide else 4).T.tobytes()
    return (2 * len(keys) + wide).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, wide = divmod(int.from_bytes(blob[:8], "little"), 2)
    each = 8 if wide else 4
    planes = np.frombuffer(pa.decompress(blob[8:], (8 + each) * size, "zstd", asbytes=True), np.uint8)
    keys = np.ascontiguousarray(planes[: 8 * size].reshape(8, -1).T).view(np.uint64)[:, 0]
    n = np.ascontiguousarray(planes[8 * size :].reshape(each, -1).T).view(np.uint64 if wide else np.uint32)[:, 0]
    return np.cumsum(keys, dtype=np.uint64), n.astype(np.int64)


_PART_ROW = f"part long, n long, total long, block binary, {_CUTS}"


def _count_level(coded: DataFrame, trie: Trie, major: np.ndarray, minor: np.ndarray, part_tokens: int) -> DataFrame:
    """A row for each range of the next level: its n-grams, their tokens, them summed, and the cuts of the level after it."""
    width, flush_at, kind = len(trie.words) + 1, FLUSH, trie.words.id_type
    spark = coded.sparkSession
    if len(major) and int(np.diff(np.append(major, major[-1])).max()) * width >= 2**63:
        raise OverflowError("a range of contexts times the words passes 64 bits: lower PART_TOKENS")
    shared = spark.sparkContext.broadcast((trie, major, minor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, major, minor = shared.value
        kept, size = [], 0

        def flush() -> pa.RecordBatch:
            context, word = np.concatenate([c for c, _ in kept]), np.concatenate([w for _, w in kept])
            if (int(context.max()) + 1) * width < 2**63:
                keys, n = np.unique(context * width + word, return_counts=True)
                context, word = keys // width, keys % width
            else:
                order = np.lexsort((word, context))
                context, word = context[order], word[order]
                begin = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])))
                n, context, word = np.diff(np.append(begin, len(context))), context[begin], word[begin]
            at = np.append(_cut_places(context, word, major, minor), len(context))
            full = np.flatnonzero(np.diff(at))
            blocks = [_pack(((context[a:b] - major[g]) * width + word[a:b]).astype(np.uint64), n[a:b]) for g, a, b in ((g, at[g], at[g + 1]) for g in full)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blocks, pa.binary())], names=["part", "block"])

        for ids, first, _ in _token_batches(batches, kind):
            context = np.where(first, -1, np.append(-1, ids[:-1]))
            word = ids
            if trie.pairs is not None:
                row, word, _ = trie.pairs.ask(context, ids)
                context = np.where(first, -1, np.append(-1, row[:-1]))
            good = context >= 0
            if good.any():
                kept.append((context[good], word[good]))
                size += len(kept[-1][0])
            if size > flush_at:
                yield flush()
                kept, size = [], 0
        if kept:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        blocks = [_unpack(b.as_py()) for b in table["block"]]
        keys, n = np.concatenate([k for k, _ in blocks]), np.concatenate([c for _, c in blocks])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        begin = _changes(keys)
        n, keys = np.add.reduceat(n, begin), keys[begin]
        values = [[part], [len(keys)], [int(n.sum())], [_pack(keys, n)], [_cuts_of(n, part_tokens)]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), _CUT_TYPE]
        return pa.table([pa.array(v, t) for v, t in zip(values, kinds)], names=["part", "n", "total", "block", "cuts"])

    blocks = coded.where("train").select("ids").mapInArrow(run, "part long, block binary")
    return blocks.groupBy("part").applyInArrow(merge, _PART_ROW)


def _token_batches(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Ids of all texts one after the other, whether each starts a text, and the rows; about ASKED tokens at a time."""
    held, size, each = [], 0, np.dtype(kind).itemsize

    def joined() -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        blobs = rows.column("ids").to_pylist()
        ids = np.frombuffer(b"".join(blobs), kind).astype(np.int64)
        first = np.zeros(len(ids) + 1, bool)
        first[np.cumsum([0] + [len(b) // each for b in blobs])] = True
        return ids, first[:-1], rows

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("ids").nbytes // each
            if size >= ASKED:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _build_level(counted: DataFrame, trie: Trie, major: np.ndarray, minor: np.ndarray, folder: str) -> tuple[Level, list]:
    """The files of a level from its ranges, and the cuts of the level after it."""
    width = len(trie.words) + 1
    rows = sorted(counted.select("part", "n", "total", "cuts").collect(), key=lambda r: r["part"])
    n = np.zeros(len(major), np.int64)
    n[[r["part"] for r in rows]] = [r["n"] for r in rows]
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    # a hot context's ranges hold nothing else
    hot = np.unique(major[minor > 0])
    first, types, tokens = np.full(len(hot), -1, np.int64), np.zeros(len(hot), np.int64), np.zeros(len(hot), np.int64)
    for r in rows:
        k = int(np.searchsorted(hot, major[r["part"]]))
        if k < len(hot) and hot[k] == major[r["part"]]:
            first[k] = offsets[r["part"]] if first[k] < 0 else first[k]
            types[k] += r["n"]
            tokens[k] += r["total"]
    hot, first, types, tokens = (x[first >= 0] for x in (hot, first, types, tokens))
    shared = counted.sparkSession.sparkContext.broadcast((trie, major, hot, types, tokens))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, major, hot, hot_types, hot_tokens = shared.value
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block")):
                keys, n = _unpack(block.as_py())
                base, local, word = int(major[part]), (keys // np.uint64(width)).astype(np.int64), (keys % np.uint64(width)).astype(np.int64)
                types = np.bincount(local)
                tokens = np.bincount(local, n)
                k = int(np.searchsorted(hot, base))
                if k < len(hot) and hot[k] == base:
                    types_all, tokens = hot_types[k : k + 1], hot_tokens[k : k + 1]
                else:
                    types_all = types
                if trie.pairs is None:
                    lower = trie.log_word(trie.words.counts(word))
                else:  # the pair of the context's second word and this one
                    own = np.flatnonzero(types)
                    begin = np.zeros(len(types), np.int64)
                    begin[own] = trie.pairs.begins(trie.pairs.successors(base + own))
                    lower = trie.pairs.logs(begin[local] + word)
                weight = DISCOUNT * types_all / np.maximum(tokens, 1)
                p = (n - DISCOUNT) / tokens[local] + weight[local] * np.power(10.0, lower)
                bits = max(1, int(word.max()).bit_length())
                arrays = EliasFano.encode(np.concatenate([[0], np.cumsum(types)]), "pointer")
                arrays |= {"word": pack_bits(word, bits), "bits": np.array([bits], np.uint8), "log": _quantise(np.log10(p)), "weight": _quantise(np.log10(np.where(weight > 0, weight, 1)))}
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([write_arrays(folder, arrays)])], names=["part", "uri"])

    # written out, so that a lost executor's files are not told twice
    files = {r["part"]: r["uri"] for r in materialise(counted.select("part", "block").mapInArrow(build, "part long, uri string"), "trie-files").collect()}
    weight = np.log10(DISCOUNT * types / np.maximum(tokens, 1)) if len(hot) else np.zeros(0)
    return Level([files.get(k) for k in range(len(major))], major, minor, offsets, hot, first, types, weight), _global_cuts(rows, offsets[[r["part"] for r in rows]])


def train_and_code(documents: DataFrame, train) -> tuple[Trie, DataFrame]:
    """The trie of the rows where ``train`` holds, and all rows coded: doc_id, train, n_tokens, n_known, base_score, ids."""
    spark = documents.sparkSession
    bounded_batches(spark)
    folder = new_path(spark, "trie")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    counts = materialise(_count_words(rows.where("train")), "words")
    tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part_tokens = max(PART_TOKENS, -(-tokens // MAX_PARTS))
    words, cuts = _write_words(counts, folder, part_tokens)
    release(counts)
    trie = Trie(words, tokens)
    shared, kind = spark.sparkContext.broadcast(trie), words.id_type

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in slices(batches):
            hashes, offsets = _with_ends(batch.column("text"))
            ids, n = trie.words.ids(hashes)
            begin = offsets[:-1]
            flat = ids.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("train"), pa.array(np.diff(offsets)), pa.array(np.add.reduceat((n > 0).astype(np.int64), begin)), pa.array(np.add.reduceat(trie.log_word(n), begin)), pa.array([flat[a:b].tobytes() for a, b in zip(begin, offsets[1:])], pa.binary())],
                names=["doc_id", "train", "n_tokens", "n_known", "base_score", "ids"],
            )

    coded = materialise(rows.mapInArrow(code, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, ids binary"), "coded", "zstd")
    for order in (2, 3):
        # a share of a word's successors are that share of all words, as their ids have a random order; of a pair's, of its second word's
        of_all = lambda row: len(words) if order == 2 else trie.pairs.types(int(trie.pairs.successors(np.array([row]))[0]))  # noqa: B023, E731
        major = np.array([r for r, _, _ in cuts], np.int64)
        minor = np.array([j * of_all(r) // of if j else 0 for r, j, of in cuts], np.int64)
        counted = materialise(_count_level(coded, trie, major, minor, part_tokens), f"ngrams-{order}")
        level, cuts = _build_level(counted, trie, major, minor, folder)
        release(counted)
        trie = Trie(words, tokens, level) if order == 2 else Trie(words, tokens, trie.pairs, level)
    return trie, coded


def score_texts(documents: DataFrame, train) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every row of documents(doc_id, text).

    The model learns from the rows where the condition ``train`` holds.  A-Z is
    lower-cased; a text's tokens are its words and one end.  Null text counts as
    empty: its only token is the end.  Very long texts are scored whole.  Without
    training rows every token has the same probability.  Repeated rows count each
    and get a row each; an empty table gives none; other columns are ignored.
    """
    trie, coded = train_and_code(documents, train)
    shared, kind = documents.sparkSession.sparkContext.broadcast(trie), trie.words.id_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for ids, first, rows in _token_batches(batches, kind):
            log = trie.log_texts(ids, first)
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in ("doc_id", "train", "n_tokens", "n_known")), pa.array(np.full(rows.num_rows, trie.tokens)), rows.column("base_score"), pa.array(np.add.reduceat(log, np.flatnonzero(first)))], names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
