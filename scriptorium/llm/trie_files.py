"""Compact memory-mapped files: named arrays, and monotone sequences in Elias-Fano form."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs

_ALIGN = 64
#: Most bytes of remote files that a worker process keeps on its local disk; those longest unused go.
LOCAL_BYTES = 4 << 30
_opened: OrderedDict[str, tuple[dict[str, np.ndarray], str | None, int]] = OrderedDict()
_folder: list[str] = []
#: Most files that a worker process holds open.
OPEN_FILES = 4096


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write a new file of arrays into a folder of any file system; its name is unique to this attempt."""
    uri = f"{folder}/{uuid.uuid4().hex}"
    system, path = _filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // _ALIGN) * _ALIGN
    text = json.dumps(head).encode()
    text = len(text).to_bytes(8, "little") + text
    text += b" " * (-len(text) % _ALIGN)
    with system.open_output_stream(path) as out:
        out.write(text)
        for a in arrays.values():
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % _ALIGN))
    return uri


def open_arrays(uri: str) -> dict[str, np.ndarray]:
    """Map a file's arrays into memory; one on a remote file system is copied to local disk first, within LOCAL_BYTES."""
    if uri in _opened:
        _opened.move_to_end(uri)
        return _opened[uri][0]
    system, path = _filesystem(uri)
    copy = None
    if not isinstance(system, fs.LocalFileSystem):
        if not _folder:
            _folder.append(tempfile.mkdtemp(prefix="trie-"))
            atexit.register(shutil.rmtree, _folder[0], ignore_errors=True)
        copy = os.path.join(_folder[0], uuid.uuid4().hex)
        with system.open_input_stream(path) as source, open(copy, "wb") as out:
            shutil.copyfileobj(source, out)
        path = copy
    raw = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    base = 8 + size + (-(8 + size) % _ALIGN)
    out = {}
    for name, (kind, n, at) in json.loads(raw[8 : 8 + size].tobytes()).items():
        kind = np.dtype(kind)
        out[name] = np.asarray(raw[base + at : base + at + n * kind.itemsize]).view(kind)
    _opened[uri] = out, copy, len(raw) if copy else 0
    while len(_opened) > 1 and (len(_opened) > OPEN_FILES or sum(x[2] for x in _opened.values()) > LOCAL_BYTES):
        _, gone, _ = _opened.popitem(last=False)[1]
        if gone:  # its pages stay until the last array is let go
            os.remove(gone)
    return out


def pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """Values below 2**bits (bits up to 63), one after the other in 64-bit words."""
    v, at = values.astype(np.uint64), np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    out = np.zeros((int(word[-1]) if len(v) else 0) + 2, np.uint64)
    if len(v):
        head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[head]] = np.bitwise_or.reduceat(v << shift, head)
        over = np.flatnonzero(shift + np.uint64(bits) > 64)  # at most one a word
        out[word[over] + 1] |= v[over] >> (np.uint64(64) - shift[over])
    return out


def bits_at(packed: np.ndarray, bits: int, places: np.ndarray) -> np.ndarray:
    """Values of ``pack_bits`` at places."""
    at = places * bits
    word = at >> 6
    at &= 63
    shift = at.view(np.uint64)
    out = packed.take(word)
    out >>= shift
    over = packed[1:].take(word)
    over <<= np.uint64(1)
    np.subtract(np.uint64(63), shift, out=shift)
    over <<= shift
    out |= over
    out &= np.uint64((1 << bits) - 1)
    return out.view(np.int64)


#: Place of the k-th one bit of each byte, at 8 * byte + k.
_PLACE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.int64).reshape(-1)


class EliasFano:
    """A monotone sequence of n values up to u in about n * (2 + log2(u / n)) bits.

    The low bits stand packed; the high bits are unary-coded in a bit vector, so the
    value of place i is (select1(i) - i) << low_bits | low(i).
    """

    @staticmethod
    def encode(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n, u = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (u // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(-(-(int(high[-1]) + 1 if n else 1) // 64) * 64, np.uint8)
        vector[high] = 1
        upper = np.packbits(vector, bitorder="little").view(np.uint64)
        low = pack_bits(values & np.uint64((1 << bits) - 1), bits) if bits else np.zeros(0, np.uint64)
        ranks = np.cumsum(np.append(0, np.bitwise_count(upper).astype(np.int64)))
        return {f"{prefix}_upper": upper, f"{prefix}_low": low, f"{prefix}_ranks": ranks.astype(np.uint32 if n < 2**32 else np.uint64), f"{prefix}_bits": np.array([bits], np.uint8)}

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.upper, self.ranks = arrays[f"{prefix}_upper"].view(np.uint64), arrays[f"{prefix}_ranks"]
        self.low, self.bits = arrays[f"{prefix}_low"], int(arrays[f"{prefix}_bits"][0])

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ranks, places, "right") - 1
        left = places - self.ranks.take(word)
        bits, value = self.upper.take(word), word * 64 - places
        # halve the word down to the byte that holds the one bit asked for
        for half in (32, 16, 8):
            low = bits & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            later = left >= ones
            bits >>= np.uint64(half)
            np.copyto(bits, low, where=~later)
            ones *= later
            left -= ones
            value += half * later
        value += _PLACE.take((bits.view(np.int64) & 255) * 8 + left)
        if self.bits:
            value = (value << self.bits) | bits_at(self.low, self.bits, places)
        return value
