"""Entities from tagged text: persons, each with the office named just before it.

Tokens are ``<O>office</O>`` and ``<P...>person</P>``.  A person has the office of
the token right before it, if that is a non-empty office ending fewer than
``MAX_GAP`` characters earlier.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_tags
from .asof import BLOCK, latest

#: Fixed value; (?d): a dot stops at line feeds only.
TOKEN = r"(?d)(<O>(.*?)</O>)|(<P.*?>(.*?)</P>)"
MAX_GAP = 5
ENTITY_TYPE = "array<struct<name:string,rank:string,event_type:string,action:string>>"


def tag_entities(text: str) -> Column:
    """Array of (name, rank, event_type, action) of a text column, in text order."""
    tokens, gaps = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)
    inner = lambda t: F.regexp_extract(t, r"(?s)^<.*?>(.*)</.>$", 1)
    is_office = lambda t: t.startswith("<O>")

    def entity(parts: Column) -> Column:
        def one(token: Column, i: Column) -> Column:
            last, gap = F.get(parts["tokens"], i - 1), F.length(F.get(parts["gaps"], i))
            office = F.substring(last, F.lit(4), F.length(last) - 7)
            ranked = last.isNotNull() & is_office(last) & (office != "") & (gap < MAX_GAP)
            name = F.when(is_office(token), F.lit(None)).otherwise(inner(token))
            return F.struct(name.alias("name"), F.when(ranked, office).alias("rank"), F.lit("N/A").alias("event_type"), F.lit("N/A").alias("action"))

        return F.filter(F.transform(parts["tokens"], one), lambda e: e["name"].isNotNull())

    parts = F.array(F.struct(tokens.alias("tokens"), gaps.alias("gaps")))
    return F.get(F.transform(parts, entity), F.lit(0))


def entities_of(tagged: DataFrame, text: str = "text_content") -> DataFrame:
    """tagged rows with ``clean`` (text without tags) and ``entities``."""
    return tagged.withColumns({"clean": strip_tags(F.col(text)), "entities": tag_entities(text)})


_TOKEN_ROW = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("inner", pa.string())])


# dots stop at line feeds here anyway
_TOKEN = re.compile(TOKEN.removeprefix("(?d)"))


def tokens_of(text: str | None) -> list[dict]:
    """start, end, kind and inner text of each token of a text."""
    row = lambda m: {"start": m.start(), "end": m.end(), "kind": "person" if m[2] is None else "office", "inner": m[4] if m[2] is None else m[2]}
    return [row(m) for m in _TOKEN.finditer(text or "")]


def token_rows(tagged: DataFrame, text: str = "text_content") -> DataFrame:
    """A row for each token of each text: the other columns, start, end, kind (``office`` or ``person``) and inner text.

    Text without a token, and null, gives no row.
    """
    @F.arrow_udf("array<struct<start:bigint,end:bigint,kind:string,inner:string>>")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array([tokens_of(t) for t in texts.to_pylist()], pa.list_(_TOKEN_ROW))

    # the outer form keeps the optimiser from writing the array expression twice
    d = tagged.select(*[c for c in tagged.columns if c != text], F.explode_outer(tokens(text)).alias("_t")).where("_t is not null")
    return d.select(*[c for c in d.columns if c != "_t"], "_t.*")


def entities_of_tokens(tokens: DataFrame, by: tuple[str, ...] = ("doc_id",), block: int = BLOCK) -> DataFrame:
    """Persons of tokens(*by, start, end, kind, inner, ...): the other columns, start, end, name, rank, event_type, action.

    The same offices as ``tag_entities`` gives a text, looked up among rows: the last
    non-empty office that ended fewer than ``MAX_GAP`` characters before the person,
    as a person between them is longer than that.  A document's tokens may come from
    many rows and be of any number: blocks of positions are tasks of their own.
    Tokens of a null place are no tokens; null keys are a document like any other.
    """
    person, rest = F.col("kind") == "person", [c for c in tokens.columns if c not in ("kind", "inner")]
    place = F.when(person, F.col("start")).otherwise(F.col("end"))
    office = F.when(~person, F.struct(F.col("end").alias("at"), F.col("inner").alias("rank")))
    row = F.when(person, F.struct(*[F.col(f"`{c}`") for c in rest], F.col("inner").alias("name")))
    events = tokens.where("start is not null and end is not null and (kind = 'person' or kind = 'office' and inner <> '')").select(
        F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(by)]).alias("k"), place.cast("long").alias("at"), office.alias("o"), row.alias("l"), office.alias("r")
    )
    near = F.col("l.start") - F.col("r.at") < MAX_GAP
    return latest(events, MAX_GAP - 1, block).select("l.*", F.when(near, F.col("r.rank")).alias("rank"), F.lit("N/A").alias("event_type"), F.lit("N/A").alias("action"))
