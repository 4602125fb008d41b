"""Pages of files as a data source: ``spark.read.format("page_files")``.

Options: ``path`` (a file or a folder, read with its folders), ``decoder`` (``module:name``
of a function from a file's bytes to an object with ``len`` and ``[k]``; form feeds between
pages by default), ``start`` and ``max_pages`` (the pages wanted, counted from 0, empty ones
too), ``slice_bytes`` (one task for so many bytes of a file), ``mode`` (``PERMISSIVE``, or
``FAILFAST`` where no file or page may be missing).

A large file is several tasks, each of which decodes its share of the pages only.  Where a
decoder names its ``separator``, a task reads the bytes of its slice alone; which page is
the first there tells an index of one count a slice (``load`` makes it by a job of its own).
Without it (option ``index``) every task counts by reading its file through, a slice at a time.
Files of other decoders are held whole by each of their tasks.
Bounds on ``page_no`` in a filter are pushed down, so that pages outside them are never
decoded.  A file or a page that can't be decoded is a row with its error; by ``FAILFAST`` it
ends the job.  A filter on ``page_no`` or ``text`` drops such rows.  A file that can't be
read, or has become shorter since it was listed, fails its task in both modes, so that Spark
tries again and no slice is missing unsaid.
"""

from __future__ import annotations

import importlib
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.parsing import storable
from ..shared import bounded_batches

SCHEMA = "doc_id string, page_no int, text string, error string"
SLICE_BYTES = 8 << 20


def form_feed_pages(content: bytes) -> list[str]:
    """The pages of a text file: a form feed ends each, the last one may lack it."""
    pages = content.decode("utf-8").split("\f")
    return pages if pages[-1] else pages[:-1]


#: Pages are cut at this byte, before they are decoded as UTF-8.
form_feed_pages.separator = b"\f"


class pdf_file:  # noqa: N801  named as the functions it stands beside
    """The pages of a PDF file, by pypdf if it is there; each is decoded when asked for."""

    def __init__(self, content: bytes):
        import io

        self.pages = importlib.import_module("pypdf").PdfReader(io.BytesIO(content)).pages

    def __len__(self) -> int:
        return len(self.pages)

    def __getitem__(self, k: int) -> str:
        return self.pages[k].extract_text() or ""


@dataclass
class _Slice(InputPartition):
    path: str
    share: int
    shares: int
    size: int
    first: int | None = None  # the number of the first page that begins in it, where an index tells
    error: str | None = None


def _span(size: int, share: int, shares: int) -> tuple[int, int]:
    return size * share // shares, size * (share + 1) // shares


def _check_read(found: int, wanted: int) -> None:
    if found != wanted:
        raise OSError(f"the file has changed while it was read: {found} bytes in place of {wanted}")


def _own_pages(f, size: int, low: int, high: int, mark: bytes) -> list[bytes]:
    """The pages that begin in [low, high) of a file; the last one may end behind it."""
    f.seek(max(0, low - 1))
    held = f.read(high - max(0, low - 1))
    _check_read(len(held), high - max(0, low - 1))
    if low:
        begin = held.find(mark) + 1
        # none begins here, or the first would begin behind
        if not begin or begin == len(held):
            return []
        held = held[begin:]
    if not held:
        return []
    if not held.endswith(mark):
        parts, at = [held], high
        while block := f.read(1 << 20):
            end = block.find(mark)
            parts.append(block if end < 0 else block[:end])
            if end >= 0:
                break
            at += len(block)
        else:
            _check_read(at, size)
        held = b"".join(parts)
    else:
        held = held[:-1]
    return held.split(mark)


def _counted(f, size: int, share: int, shares: int, mark: bytes) -> tuple[int, str | None]:
    """How many pages begin in a slice, and an error if one of them is no UTF-8."""
    own = _own_pages(f, size, *_span(size, share, shares), mark)
    try:
        for page in own:
            page.decode("utf-8")
    except UnicodeDecodeError as e:
        return len(own), f"UnicodeDecodeError: {e}"
    return len(own), None


def _decoder(name: str) -> Callable[[bytes], Sequence[str]]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.decoder = options["path"], options.get("decoder", f"{__name__}:form_feed_pages")
        self.slice_bytes = int(options.get("slice_bytes", SLICE_BYTES))
        self.first, most = max(0, int(options.get("start", 0))), options.get("max_pages")
        self.end = math.inf if most is None else self.first + int(most)
        self.wanted: set[int] | None = None
        self.mode = options.get("mode", "PERMISSIVE").upper()
        if self.mode not in ("PERMISSIVE", "FAILFAST"):
            raise ValueError(f"mode of page_files: {self.mode}")
        self.index = json.loads(options["index"]) if "index" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            whole = type(getattr(f, "value", None)) is int
            if getattr(f, "attribute", None) != ("page_no",):
                yield f
            elif isinstance(f, EqualTo) and whole:
                self.first, self.end = max(self.first, f.value), min(self.end, f.value + 1)
            elif isinstance(f, GreaterThan) and whole:
                self.first = max(self.first, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual) and whole:
                self.first = max(self.first, f.value)
            elif isinstance(f, LessThan) and whole:
                self.end = min(self.end, f.value)
            elif isinstance(f, LessThanOrEqual) and whole:
                self.end = min(self.end, f.value + 1)
            elif isinstance(f, In) and all(type(v) is int for v in f.value):
                self.wanted = set(f.value) if self.wanted is None else self.wanted & set(f.value)
            else:
                # page_no IS NOT NULL and the like: Spark's own filter sees to it
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        named = [(f.path, f.size) for f in files if f.is_file and not any(p.startswith(("_", ".")) for p in f.path[len(path) :].split("/") if p) or f.path == path and f.is_file]
        if gone := set(self.index or ()) - {name for name, _ in named}:
            raise FileNotFoundError(f"counted before, and gone now: {min(gone)}")
        out = []
        for name, size in sorted(named):
            shares = max(1, math.ceil(size / self.slice_bytes))
            told = None if self.index is None else self.index.get(name)
            if told is None or len(told["counts"]) != shares or told["size"] != size:
                out += [_Slice(name, k, shares, size) for k in range(shares)]
            elif told["error"]:
                out.append(_Slice(name, 0, shares, size, 0, told["error"]))
            else:
                first = 0
                for k, n in enumerate(told["counts"]):
                    if first < self.end and first + n > self.first and (self.wanted is None or any(first <= w < first + n for w in self.wanted)):
                        out.append(_Slice(name, k, shares, size, first))
                    first += n
        return out

    def _opened(self, name: str):
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        return system.open_input_file(name)

    def _failed(self, name: str, k: int | None, error: str) -> tuple:
        """The row of a page, or with no number of a file, that can't be decoded."""
        if self.mode == "FAILFAST":
            raise ValueError(f"{name}{'' if k is None else f', page {k}'}: {error}")
        return name, k, None, error

    def _slice(self, partition: _Slice, mark: bytes) -> Iterator[tuple]:
        """The wanted pages that begin in a slice of a file cut at a byte."""
        name, size, share, shares = partition.path, partition.size, partition.share, partition.shares
        with self._opened(name) as f:
            first, bad = partition.first, partition.error
            if first is None:
                first = 0
                for k in range(shares):
                    n, wrong = _counted(f, size, k, shares, mark)
                    bad = bad or wrong
                    first += n if k < share else 0
            if bad:
                if share == 0:
                    yield self._failed(name, None, bad)
                return
            for k, page in enumerate(_own_pages(f, size, *_span(size, share, shares), mark), first):
                if self.first <= k < self.end and (self.wanted is None or k in self.wanted):
                    yield name, k, page.decode("utf-8"), None

    def read(self, partition: _Slice) -> Iterator[tuple]:
        name = partition.path
        decoder = _decoder(self.decoder)
        if mark := getattr(decoder, "separator", None):
            yield from self._slice(partition, mark)
            return
        with self._opened(name) as f:
            content = f.read()
        _check_read(len(content), partition.size)
        try:
            pages = decoder(content)
            # the wanted pages are shared out, not all, so that a short range of a large file is still several tasks
            first, end = min(self.first, len(pages)), min(self.end, len(pages))
        except MemoryError:  # a failure of this task, not of the file
            raise
        except Exception as e:  # noqa: BLE001  a bad file must not end the job
            if partition.share == 0:
                yield self._failed(name, None, f"{type(e).__name__}: {e}")
            return
        del content
        n = max(0, end - first)
        for k in range(first + n * partition.share // partition.shares, first + n * (partition.share + 1) // partition.shares):
            if self.wanted is None or k in self.wanted:
                try:
                    row = name, k, storable(pages[k] or ""), None
                except MemoryError:
                    raise
                except Exception as e:  # noqa: BLE001  nor must a bad page
                    row = self._failed(name, k, f"{type(e).__name__}: {e}")
                yield row


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("page_files needs a path")
        return PageReader(dict(self.options))


class CountReader(PageReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from filters

    def read(self, partition: _Slice) -> Iterator[tuple]:
        with self._opened(partition.path) as f:
            n, error = _counted(f, partition.size, partition.share, partition.shares, _decoder(self.decoder).separator)
        yield partition.path, partition.share, partition.size, n, error


class PageCounts(PageFiles):
    @classmethod
    def name(cls) -> str:
        return "page_counts"

    def schema(self) -> str:
        return "path string, share int, size long, n long, error string"

    def reader(self, schema) -> DataSourceReader:
        return CountReader(dict(self.options))


def load(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """``page_files`` of a path; where the decoder names a separator, by an index: a job counts each slice's pages, one number a slice comes to the driver."""
    register(spark)
    if getattr(_decoder(str(options.get("decoder", f"{__name__}:form_feed_pages"))), "separator", None) and "index" not in options:
        index: dict[str, dict] = {}
        for r in spark.read.format("page_counts").options(**options).load(path).orderBy("path", "share").collect():
            told = index.setdefault(r.path, {"size": r.size, "counts": [], "error": None})
            told["counts"].append(r.n)
            told["error"] = told["error"] or r.error
        options["index"] = json.dumps(index)
    return spark.read.format("page_files").options(**options).load(path)


def register(spark: SparkSession) -> None:
    """Make ``page_files`` known to a session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bounded_batches(spark)
    spark.dataSource.register(PageFiles)
    spark.dataSource.register(PageCounts)
