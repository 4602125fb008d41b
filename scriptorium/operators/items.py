"""Validation, grounding and deduplication of extracted items: column expressions and one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EVENT_TYPES
from ..functions.text import strip

#: Title endings, and the kinship form whose second name counts.
TITLE_LIKE = "(皇帝|皇后|太子|皇太子|公主|国王|王爷|王|后|帝)$"
KINSHIP = r"(?d)^(.{1,6})孙(.{1,6})$"
QUOTE_LENGTH = (5, 60)
KEY = ("name", "rank", "action", "event_type", "time", "quote")


def kinship_name(name: Column) -> Column:
    """The descendant's name where a name has the kinship form."""
    second = F.regexp_extract(name, KINSHIP, 2)
    return F.when(second != "", strip(second)).otherwise(name)


def none_if_null(x: Column) -> Column:
    """Null for "" and "null" - exactly these."""
    return F.when(x.isin("", "null"), None).otherwise(x)


def normalize_items(items: DataFrame, exclude_title_like: bool = False, kinship: bool = True) -> DataFrame:
    """Items with a name and a quote of 5 to 60 characters; name stripped, empty rank and time null."""
    d = items.withColumn("name", strip(F.col("name"))).where("name <> ''")
    if exclude_title_like:
        d = d.where(~F.col("name").rlike(TITLE_LIKE))
    if kinship:
        d = d.withColumn("name", kinship_name(F.col("name")))
    d = d.withColumns({c: none_if_null(F.col(c)) for c in ("rank", "time")})
    d = d.where(F.length(strip(F.coalesce("quote", F.lit("")))).between(*QUOTE_LENGTH))
    return d.withColumn("_reasoning", F.substring("_reasoning", 1, 120)) if "_reasoning" in d.columns else d


def valid_event_type(column: Column) -> Column:
    return F.coalesce(column.isin(*EVENT_TYPES), F.lit(False))


def optional_name_filters(items: DataFrame, kinship_only: bool = False, single_char: bool = False, max_length: int | None = None) -> DataFrame:
    """Optional filters, all off by default: kinship terms alone, one-character names, overlong names."""
    name = strip(F.col("name"))
    if kinship_only:
        items = items.where(~name.rlike("^[父母兄弟姊妹子女孙祖叔伯舅姑妻妾]+$"))
    if single_char:
        items = items.where(F.length(name) > 1)
    return items if max_length is None else items.where(F.length(name) <= max_length)


def ground(items: DataFrame, segment: str = "seg_text") -> DataFrame:
    """Items whose quote, as it stands, occurs in its segment; the segment is dropped before anything is shuffled."""
    return items.where(F.coalesce(F.contains(F.col(segment), F.col("quote")), F.lit(False))).drop(segment)


def dedup_key() -> list[Column]:
    return [strip(F.coalesce(F.col(c), F.lit(""))) for c in KEY]


def dedup(items: DataFrame, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first item (by doc_id, chunk_id, seg_id, item_idx) of each key in a document; with other ``scope`` columns,
    or none, keys meet there or everywhere.

    Grouped on the key's digest, with the least position: partial sums shrink a hot
    key before the shuffle, and only one row a key crosses the second one.
    """
    order = [c for c in ("doc_id", "chunk_id", "seg_id", "item_idx") if c in items.columns]
    digest = F.sha2(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(dedup_key())])), 256)
    rest = [c for c in items.columns if c not in order]
    g = items.withColumn("_key", digest).groupBy(*scope, "_key") if scope else items.withColumn("_key", digest).groupBy("_key")
    out = g.agg(F.min(F.struct(*order, *[c for c in rest if c not in scope])).alias("_first"))
    return out.select("_first.*", *[c for c in scope if c not in order]).select(items.columns)


def dedup_window(items: DataFrame, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same by row numbers: the form to compare with."""
    w = Window.partitionBy(*scope, *dedup_key()).orderBy("doc_id", "chunk_id", "seg_id", "item_idx")
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
