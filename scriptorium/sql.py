"""The operators as functions of SQL: ``register(spark)`` once, then call them in any query.

    SELECT * FROM page_chunks(TABLE(SELECT doc_id, page_no, normalized_text(text) AS text FROM pages), 900, 120)
    SELECT d.doc_id, i.* FROM answers d, LATERAL answer_items(d.raw, 'lenient') i

The scalar function is inlined, and belongs in the query that a table function reads,
not among its arguments.  Table functions give the rows of the DataFrame
operators, and state what they need when a query is analysed, so that a wrong
argument is an error before any row is read.  They run a Python call a row; over
whole tables the DataFrame operators, which see a batch a call, are the faster way.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from .config import CUT_LOOKBACK, EVENT_TYPES, MARKERS
from .functions.text import BLANKS
from .operators import parsing
from .operators.chunking import chunks_of, cut, next_start
from .operators.segments import grouper
from .operators.tags import tokens_of


def _schema(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _text(argument: AnalyzeArgument) -> None:
    if argument.isTable or not isinstance(argument.dataType, (T.StringType, T.NullType)):
        raise ValueError("the first argument must be a text")


def _constant(argument: AnalyzeArgument, name: str, good) -> None:
    if not argument.isConstantExpression or argument.value is None or not good(argument.value):
        raise ValueError(f"{name} has no such value: {argument.value!r}" if argument.isConstantExpression else f"{name} must be a constant")


def _geometry(size: AnalyzeArgument, overlap: AnalyzeArgument) -> None:
    _constant(size, "size", lambda n: isinstance(n, int) and n > 0)
    # the earliest cut must lie beyond the overlap, or the next chunk would begin where this one did
    _constant(overlap, "overlap", lambda n: isinstance(n, int) and 0 <= n < min(size.value, max(2, size.value - CUT_LOOKBACK + 1)))


class TextChunks:
    """text_chunks(text, size, overlap): (chunk_id, start, end, chunk_text) of one normalised text; none of null."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        _geometry(size, overlap)
        return AnalyzeResult(_schema("chunk_id int, start int, end int, chunk_text string"))

    def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple]:
        for n, piece in enumerate(chunks_of(text, size, overlap)):
            yield n, *piece


class PageChunks:
    """page_chunks(TABLE(pages), size, overlap): (doc_id, chunk_id, chunk_text); doc_id keeps its type.

    pages(doc_id, page_no, text), texts normalised.  Partitioning and order are its own:
    the pages of a document, the nulls as one, come one after the other, and no more of
    their text is held than the next chunk needs.  Empty and null pages are skipped.
    """

    @staticmethod
    def analyze(pages: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or not {"doc_id", "page_no", "text"} <= {f.name for f in pages.dataType}:
            raise ValueError("the first argument must be a table of doc_id, page_no and text")
        _geometry(size, overlap)
        schema = T.StructType([T.StructField("doc_id", pages.dataType["doc_id"].dataType), *_schema("chunk_id int, chunk_text string")])
        return AnalyzeResult(
            schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("page_no"), OrderingColumn("text")], select=[SelectedColumn(c) for c in ("doc_id", "page_no", "text")]
        )

    def __init__(self):
        self.doc_id, self.held, self.next = None, "", 0

    def _emit(self, text: str) -> Iterator[tuple]:
        if text := text.strip():
            yield self.doc_id, self.next, text
            self.next += 1

    def eval(self, page: T.Row, size: int, overlap: int) -> Iterator[tuple]:
        self.doc_id = page["doc_id"]
        if not page["text"]:
            return
        self.held, at = (self.held + "\n" if self.held else "") + page["text"], 0
        for start, end in cut(self.held, size, overlap):
            yield from self._emit(self.held[start:end])
            at = next_start(start, end, overlap)
        self.held = self.held[at:]

    def terminate(self) -> Iterator[tuple]:
        yield from self._emit(self.held)


class TextSegments:
    """text_segments(text, per_request): (seg_id, seg_text) of one normalised chunk, split at item markers; none of null."""

    @staticmethod
    def analyze(text: AnalyzeArgument, per_request: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        _constant(per_request, "per_request", lambda n: isinstance(n, int) and n > 0)
        return AnalyzeResult(_schema("seg_id int, seg_text string"))

    def eval(self, text: str | None, per_request: int) -> Iterator[tuple]:
        yield from enumerate(grouper(per_request, MARKERS)(text) if text is not None else ())


class TextTokens:
    """text_tokens(text): (start, end, kind, inner) of the tags of a text."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        return AnalyzeResult(_schema("start long, end long, kind string, inner string"))

    def eval(self, text: str | None) -> Iterator[tuple]:
        for t in tokens_of(text):
            yield tuple(t.values())


class AnswerItems:
    """answer_items(raw, form): (parsed_ok, item_idx, known fields, extra) of an answer, form ``lenient`` or ``structured``.

    An answer that can't be parsed is one row with parsed_ok false; one without items has none.
    """

    @staticmethod
    def analyze(raw: AnalyzeArgument, form: AnalyzeArgument) -> AnalyzeResult:
        _text(raw)
        _constant(form, "form", ("lenient", "structured").__contains__)
        return AnalyzeResult(_schema("parsed_ok boolean, item_idx int, " + ", ".join(f"{k} string" for k in (*parsing.KNOWN, "extra"))))

    def eval(self, raw: str | None, form: str) -> Iterator[tuple]:
        good, found = parsing.parse_json_list(raw) if form == "lenient" else parsing.parse_structured(raw, EVENT_TYPES)
        if not good:
            yield (False, *[None] * (len(parsing.KNOWN) + 2))
        for n, item in enumerate(found if good else ()):
            yield True, n, *[item[k] for k in (*parsing.KNOWN, "extra")]


TABLE_FUNCTIONS = {"text_chunks": TextChunks, "page_chunks": PageChunks, "text_segments": TextSegments, "text_tokens": TextTokens, "answer_items": AnswerItems}


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session; again changes nothing."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalized_text(t STRING) RETURNS STRING RETURN "
        rf"btrim(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', '\n'), '[ \\t]+', ' '), '\\n{{3,}}', '\n\n'), '{BLANKS}')"
    )
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(function, useArrow=False))
