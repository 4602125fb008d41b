"""Secret scans by dictionary-primed zstandard novelty.

Three patterns give the base spans.  Every long token near a sensitive word, and
every base span, is scored: its novelty is the number of bytes by which the
compressed size of its text window grows when the token is put back into it, with
a compressor primed by the text around it and a dictionary of identifiers.  Words
and names cost little, random strings cost most of their length.  Other
occurrences of the token are blanked around it, or a repeated secret would vouch
for itself.

The dictionary has fixed names and the corpus' own identifiers: the most frequent
words around long tokens, counted over all texts, ``DICTIONARY_BYTES`` of them.
Its words are shorter than any token that is scored, so that no secret, however
often copied, gets into it.

    score = novelty a character * nearness * surprise

nearness: 1 within ``NEAR`` characters of a sensitive word on either side, falling to
0 at ``FAR``; surprise: how far the token's bits a character, under the dictionary's
letter pairs, lie on the way from those of words to those of random letters (0 to
1; a long word that the compressor has not met is as new to it as a key, but not as
surprising).  Tokens of at least ``MIN_SCORE`` and ``MIN_NOVELTY`` bytes that no base
span overlaps are reported as ``novel`` spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches
from .wordhash import slices

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns with the fewest characters that count.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16

#: Words that make what stands near them a likely secret, in either case.
SENSITIVE = ("passw", "passwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "private", "auth", "bearer", "signature", "akia")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.IGNORECASE)
MIN_TOKEN = 16
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")
#: Code points around a token that prime the compressor, and in which sensitive words count in full or at all.
WINDOW, NEAR, FAR = 400, 64, 256
MIN_NOVELTY, MIN_SCORE = 14, 0.55
#: Words of the dictionary: letters and joints, two digits at most, shorter than any token and no part of one but a name before a sign.
_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{4,13}[0-9]{0,2}(?![A-Za-z0-9+/_-])")
DICTIONARY_BYTES = 16_384
_FLUSH = 200_000
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, n_scored long, base_sha256 string, spans string, novelty string"
_FIRST = ("access", "account", "api", "auth", "aws", "base", "client", "config", "database", "default", "github", "google", "private", "public", "secret", "service", "session", "user")
_SECOND = ("address", "code", "credentials", "id", "identifier", "key", "name", "number", "password", "path", "secret", "string", "token", "url", "value", "version")
_NAMES = _FIRST + _SECOND
_IDENTIFIERS = " ".join(a + sep + b for sep in ("_", "", "-") for a in _FIRST for b in _SECOND)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the base patterns, in order of start, then kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Surprise:
    """Bits a character of a token under the letter pairs of words, on a scale from words (0) to random letters (1).

    Letters fold to lower case; a name starts anew after a sign, a digit or where
    capitals begin.  Digits are as surprising as random letters, since words hold two
    at most; signs join words and count 0; a change to capitals costs what ``CAPITALS``
    of them a letter makes it.
    """

    CAPITALS = 1 / 8
    _START = 26

    def __init__(self, words: list[str]):
        counts = np.zeros((27, 26))
        for word in words:
            np.add.at(counts, self._pairs(word)[:2], 1)
        single = counts.sum(0) + 1
        single /= single.sum()
        # pairs never met fall back to single letters
        chance = (counts + 8 * single) / (counts.sum(1, keepdims=True) + 8)
        self._bits = -np.log2(chance)
        seen = counts.sum()
        self._low = float((counts * self._bits).sum() / seen) if seen else 0.0
        self._scale = max(float(self._bits[:26].mean()) - self._low, 1e-9)
        self._capital = -np.log2(self.CAPITALS) / self._scale

    def _pairs(self, token: str) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Letter or start before each letter, the letter, how often capitals begin inside a name, and digits."""
        code = np.frombuffer(token.encode("ascii", "replace"), np.uint8).astype(np.int64)
        upper, lower = (code >= 65) & (code <= 90), (code >= 97) & (code <= 122)
        letter = upper | lower
        folded = np.where(upper, code - 65, code - 97)
        before = np.full(len(code), self._START)
        turn = np.zeros(len(code), bool)
        turn[1:] = upper[1:] & lower[:-1]
        joined = np.zeros(len(code), bool)
        joined[1:] = letter[:-1] & ~turn[1:]
        before[joined] = folded[:-1][joined[1:]]
        return before[letter], folded[letter], int(turn.sum()), int(((code >= 48) & (code <= 57)).sum())

    def __call__(self, token: str) -> float:
        before, letters, turns, digits = self._pairs(token)
        total = (self._bits[before, letters] - self._low).sum() / self._scale + turns * self._capital + digits
        return min(1.0, max(0.0, float(total) / max(len(token), 1)))


class Novelty:
    """Marginal compressed bytes of a token in its surroundings."""

    def __init__(self, words: list[str] = ()):
        import zstandard

        self.surprise = Surprise([*words, *_NAMES])
        self._zstd = zstandard
        # what stands last is found soonest
        self._base = " ".join([*reversed(words), _IDENTIFIERS]).encode()

    def __call__(self, before: str, token: str, after: str) -> int:
        primer = self._base + b"\n" + before.encode() + b"\n" + after.encode()
        known = self._zstd.ZstdCompressionDict(primer, dict_type=self._zstd.DICT_TYPE_RAWCONTENT)
        coder = self._zstd.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_content_size=False)
        near = before[-32:].encode()
        return len(coder.compress(near + token.encode() + after[:32].encode())) - len(coder.compress(near + after[:32].encode()))


def surroundings(text: str, a: int, b: int) -> tuple[str, str]:
    """The ``WINDOW`` code points before a and after b, every other occurrence of the token, or of a long value it sets, blanked.

    Each value is looked for as far as one that the window's edge cuts can reach, so that a
    token of many values costs their lengths and a window each.
    """
    low, high = max(0, a - WINDOW), min(len(text), b + WINDOW)
    before, after = list(text[low:a]), list(text[b:high])
    for own in dict.fromkeys((text[a:b], *text[a:b].split("="))):
        n = len(own)
        if n >= MIN_TOKEN:
            for side, first, end in ((before, low, a), (after, b, high)):
                begin, stop = (max(0, first - n), a) if side is before else (b, min(len(text), end + n))
                at = text.find(own, begin, stop)
                while at >= 0:
                    for k in range(max(at, first), min(at + n, end)):
                        side[k - first] = " "
                    at = text.find(own, at + n, stop)
    return "".join(before), "".join(after)


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty) -> tuple[list[tuple[int, int, int]], int]:
    """(begin, end, novelty) of the tokens to report, none overlapped by a base span; and how many tokens were scored."""
    sensitive = [m.span() for m in _SENSITIVE.finditer(text)]
    if not sensitive:
        return [], 0
    ends = [e for _, e in sensitive]
    begins = [t[0] for t in taken]
    reach = list(accumulate((t[2] for t in taken), max))  # farthest end of the base spans up to each
    out, scored = [], 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        k = bisect_right(ends, a)  # the next sensitive word ends after a
        k_after = bisect_left(sensitive, (b, 0))
        distance = min(a - ends[k - 1] if k else FAR, sensitive[k_after][0] - b if k_after < len(sensitive) else FAR)
        nearness = 1 - max(0, distance - NEAR) / (FAR - NEAR)
        j = bisect_left(begins, b)
        if nearness <= 0 or (j and reach[j - 1] > a):
            continue
        scored += 1
        new = novelty(*_put(text, a, b))
        if new >= MIN_NOVELTY and new / (b - a) * nearness * novelty.surprise(m[0]) >= MIN_SCORE:
            out.append((a, b, new))
    return out, scored


def _put(text: str, a: int, b: int) -> tuple[str, str, str]:
    before, after = surroundings(text, a, b)
    return before, text[a:b], after


def scan_text(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int]], int]:
    """Base spans (start, kind's place, end); all spans with their novelty; how many tokens were scored."""
    base = base_spans(text)
    extra, scored = novel_spans(text, base, novelty)
    every = [(a, k, b, novelty(*_put(text, a, b))) for a, k, b in base] + [(a, 3, b, new) for a, b, new in extra]
    return base, sorted(every), scored + len(base)


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def dictionary(documents: DataFrame) -> list[str]:
    """The most frequent words around long tokens of all texts, DICTIONARY_BYTES at most; of equal counts the first by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                at = 0
                for m in _TOKEN.finditer(text or ""):
                    low, high = max(at, m.start() - WINDOW), m.end() + WINDOW
                    if high > at:  # what two windows share counts once
                        seen.update(_WORD.findall(text, low, high))
                        at = high
            if len(seen) > _FLUSH:
                yield pa.RecordBatch.from_pydict({"word": list(seen), "n": pa.array(seen.values(), pa.int64())})
                seen.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = documents.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # words have five bytes at least, with the blank after them
    first = counted.orderBy(F.desc("n"), "word").limit(DICTIONARY_BYTES // 5).collect()
    size = list(accumulate(len(r["word"]) + 1 for r in first))
    return [r["word"] for r, n in zip(first, size) if n <= DICTIONARY_BYTES]


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, counts by kind, n_scored, base_sha256, spans and novelty (kind:start:end:bytes) of every row of documents(doc_id, text).

    Null and empty texts: no spans.  Offsets are code points, ends exclusive.  Long
    texts take time in proportion to their length.  Base spans of different kinds
    may overlap; of equal starts the kinds go as listed.  Repeated rows get a row
    each; an empty table gives none; other columns are ignored.
    """
    bounded_batches(documents.sparkSession)
    words = dictionary(documents)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, every, scored = scan_text(text or "", novelty)
                n = [0] * 4
                for _, k, _, _ in every:
                    n[k] += 1
                rows.append((doc_id, *n, scored, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), ",".join(f"{KINDS[k]}:{a}:{b}:{new}" for a, k, b, new in every)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
