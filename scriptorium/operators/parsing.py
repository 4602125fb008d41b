"""Strict parsing of model responses and of literal cells.

Built-in JSON functions accept tails, single quotes and more; the rules here are
those of a strict JSON reader, so an Arrow UDF owns them.  ``parsed_ok`` tells an
empty answer from a failure.
"""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded_batches

KNOWN = ("name", "rank", "action", "event_type", "time", "quote")
ITEM_TYPE = "struct<" + ",".join(f"{k}:string" for k in (*KNOWN, "extra")) + ">"
PARSED_TYPE = f"struct<parsed_ok:boolean,items:array<{ITEM_TYPE}>>"
_ITEM = pa.struct([(k, pa.string()) for k in (*KNOWN, "extra")])
_PARSED = pa.struct([("parsed_ok", pa.bool_()), ("items", pa.list_(_ITEM))])
_BRACKETED = re.compile(r"\[[\s\S]*\]|\{[\s\S]*\}")


_SURROGATE = re.compile("[\ud800-\udfff]")


def storable(text: str) -> str:
    """text with the replacement character for each lone surrogate, which JSON can hold and UTF-8 can't."""
    return _SURROGATE.sub("\ufffd", text)


def _no_constant(name: str):
    raise ValueError(name)


def strict_object(line: str | None) -> dict | None:
    """The object that a line of JSON Lines holds; None if it is blank or anything else: no strict JSON, a tail, NaN, a list, a bare value."""
    try:
        found = json.loads((line or "").strip(), parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _text(value) -> str | None:
    return value if value is None else storable(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def _item(found: dict) -> dict:
    rest = {k: v for k, v in found.items() if k not in KNOWN}
    return {k: _text(found.get(k)) for k in KNOWN} | {"extra": _text(rest) if rest else None}


def parse_json_list(raw: str | None) -> tuple[bool, list[dict]]:
    """(parsed, items) of a lenient model's answer.

    A fenced block is taken out of its fence; text that doesn't start with a
    bracket is searched for the first bracketed stretch; an object counts as a list
    of one; other members are skipped; ``official_name`` stands in where there is
    no ``name``; items without a name are dropped.
    """
    if not raw:
        return False, []
    text = raw.strip()
    if "```" in text and len(parts := text.split("```")) >= 3:
        text = parts[1]
        text = (text[4:] if text[:4].lower() == "json" else text).strip()
    if not text.startswith(("[", "{")):
        if not (m := _BRACKETED.search(text)):
            return False, []
        text = m[0]
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):
        return False, []
    data = [data] if isinstance(data, dict) else data
    if not isinstance(data, list):
        return False, []
    items = []
    for member in data:
        if isinstance(member, dict):
            if "official_name" in member and "name" not in member:
                member = {"name": member["official_name"], **{k: v for k, v in member.items() if k != "official_name"}}
            if member.get("name") and str(member["name"]) != "[]":
                items.append(_item(member))
    return True, items


def parse_structured(raw: str | None, allowed: tuple[str, ...]) -> tuple[bool, list[dict]]:
    """(valid, items) of a structured service's answer: {"items": [...]}.

    An empty text and JSON that is no object are valid and empty.  One item with a
    missing or wrong field makes the whole answer invalid.
    """
    text = (raw or "").strip()
    if not text:
        return True, []
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):
        return False, []
    if not isinstance(data, dict):
        return True, []
    members = data.get("items", [])
    if not isinstance(members, list):
        return False, []
    for m in members:
        if not isinstance(m, dict) or any(not isinstance(m.get(k), str) for k in ("name", "action", "quote")):
            return False, []
        if m.get("event_type") not in allowed or any(not isinstance(m.get(k), (str, type(None))) for k in ("rank", "time")):
            return False, []
    return True, [_item({k: m.get(k) for k in KNOWN}) for m in members]


def _column(parse):
    @F.arrow_udf(PARSED_TYPE)
    def parsed(raw: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("parsed_ok", "items"), parse(r))) for r in raw.to_pylist()], _PARSED)

    return parsed


def parse_responses(responses: DataFrame, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """responses with ``raw`` to the same columns, parsed_ok and items; ``allowed`` event types select the structured form."""
    bounded_batches(responses.sparkSession)
    parse = _column(parse_json_list if allowed is None else lambda r: parse_structured(r, allowed))
    return responses.withColumn("_p", parse("raw")).select(*responses.columns, "_p.parsed_ok", "_p.items")


def explode_items(parsed: DataFrame) -> DataFrame:
    """One row for each item, with ``item_idx``; the columns beside items stay."""
    rest = [c for c in parsed.columns if c not in ("items", "parsed_ok")]
    d = parsed.select(*rest, F.posexplode_outer("items").alias("item_idx", "item")).where("item is not null")
    return d.select(*rest, F.col("item_idx").cast("int").alias("item_idx"), *[F.col(f"item.{k}").alias(k) for k in (*KNOWN, "extra")])


def dead_letters(parsed: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows whose response failed; ``cap`` keeps the first by document and chunk."""
    failed = parsed.where(~F.col("parsed_ok")).select(*[c for c in parsed.columns if c not in ("items", "parsed_ok")])
    return failed if cap is None else failed.orderBy(*[c for c in ("doc_id", "chunk_id") if c in failed.columns]).limit(cap)


def literal_texts(cell: str | None) -> list[tuple[str, str, str]]:
    """(id, source, text) of the tuples of a literal list; a bad tuple ends the cell, those before it stay."""
    out: list[tuple[str, str, str]] = []
    if cell is None or cell == "N/A":
        return out
    try:
        for item in ast.literal_eval(cell):
            if len(item) >= 3:
                if not isinstance(item[2], str):
                    break
                out.append(tuple(storable(str(x)) for x in item[:3]))
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        pass
    return out


def parse_cells(rows: DataFrame, column: str = "Related Texts") -> DataFrame:
    """(id, source, text_content) of the literal cells of a column."""
    bounded_batches(rows.sparkSession)
    kind = pa.list_(pa.struct([("id", pa.string()), ("source", pa.string()), ("text_content", pa.string())]))

    @F.arrow_udf("array<struct<id:string,source:string,text_content:string>>")
    def cells(cell: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("id", "source", "text_content"), t)) for t in literal_texts(c)] for c in cell.to_pylist()], kind)

    return rows.select(F.explode_outer(cells(F.col(f"`{column}`"))).alias("t")).where("t is not null").select("t.*")
