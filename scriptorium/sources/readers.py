"""Page, cell and line sources."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.parsing import storable, strict_object
from ..shared import bounded_batches

PAGE_SCHEMA = "doc_id string, page_no int, text string, error string"


def pdf_pages(spark: SparkSession, path: str, decode: Callable[[bytes, int, int | None], list[str]] | None = None, start: int = 0, max_pages: int | None = None) -> DataFrame:
    """(doc_id, page_no from 0, text, error) of the pages [start, start + max_pages) of PDF files.

    ``decode(content, start, max_pages)`` gives the texts of those pages only; pypdf
    by default.  A file that can't be decoded is one row with its error and no page.
    """
    if decode is None:
        try:
            reader = importlib.import_module("pypdf").PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF needs pypdf, or a decode function") from e

        def decode(content: bytes, start: int, max_pages: int | None) -> list[str]:
            import io

            pages = reader(io.BytesIO(content)).pages
            end = len(pages) if max_pages is None else min(len(pages), start + max_pages)
            return [pages[k].extract_text() or "" for k in range(start, end)]

    start = max(0, start)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    pages = list(decode(content, start, max_pages))
                except Exception as e:  # noqa: BLE001  a bad file must not end the job
                    yield pd.DataFrame({"doc_id": [name], "page_no": pd.array([None], "Int32"), "text": [None], "error": [f"{type(e).__name__}: {e}"]})
                    continue
                yield pd.DataFrame({"doc_id": name, "page_no": range(start, start + len(pages)), "text": pages, "error": None})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def page_range(pages: DataFrame, start: int = 0, max_pages: int | None = None) -> DataFrame:
    """Non-empty pages of [start, start + max_pages); pages are counted before empty ones go.

    Rows with an error in place of a text go as well: look for them first, or read with mode ``FAILFAST``.
    """
    start = max(0, start)
    inside = F.col("page_no") >= start
    if max_pages is not None:
        inside &= F.col("page_no") < start + max_pages
    return pages.where(inside).where("text <> ''")


def page_store(pages: DataFrame) -> DataFrame:
    """(doc_id, pages): each document's pages in order, numbered from 1, empty ones kept as ""."""
    page = F.struct((F.col("page_no") + 1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))


def tagged_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; cells may hold line feeds and doubled quotes.  Empty and N/A cells are null."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return d.select(*[F.when(F.col(f"`{c}`").isin("", "N/A"), None).otherwise(F.col(f"`{c}`")).alias(c) for c in d.columns])


class _Misfit(ValueError):
    pass


_LIMITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _fitted(value, kind: T.DataType):
    """A JSON value as a column's value; _Misfit if it is of another kind.  No value is turned into another kind but a whole number into a fraction."""
    if value is None:
        return None
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return storable(value)
    if isinstance(kind, T.BooleanType) and isinstance(value, bool):
        return value
    if type(kind) in _LIMITS and type(value) is int and -(1 << _LIMITS[type(kind)] - 1) <= value < 1 << _LIMITS[type(kind)] - 1:
        return value
    if isinstance(kind, (T.DoubleType, T.FloatType)) and type(value) in (int, float):
        return float(value)
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [_fitted(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return {k: _fitted(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return {f.name: _fitted(value.get(f.name), f.dataType) for f in kind}
    raise _Misfit(kind)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines with a given schema, a row for each line that is one strict JSON object whose fields have the schema's kinds.

    Blank lines, single quotes, tails, NaN, lists, bare values and fields of another
    kind make a line malformed: it is skipped.  A field that is absent or null is null,
    fields that the schema lacks are left out, of a repeated one the last counts.
    """
    bounded_batches(spark)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = to_arrow_type(kind)

    def row(line: str | None) -> dict | None:
        found = strict_object(line)
        try:
            return None if found is None else _fitted(found, kind)
        except (_Misfit, OverflowError):
            return None

    @F.arrow_udf(kind)
    def rows(x: pa.Array) -> pa.Array:
        return pa.array([row(t) for t in x.to_pylist()], out)

    return spark.read.text(path).select(rows("value").alias("r")).where("r is not null").select("r.*")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def peek(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return rows.orderBy(*order).limit(n)
