"""Open fields of items: what a model adds beyond the known fields, as VARIANT.

A field may be absent, null or hold a value, and answers differ in which fields
they have and of what kind; none of it is known before the answers are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _path(name: str) -> str:
    """The path of a top field, whatever characters its name has but for both quotes at once."""
    quote = next((q for q in "'\"" if q not in name), None)
    if quote is None:
        raise ValueError(f"a field name with both quotes has no path: {name}")
    return f"$[{quote}{name}{quote}]"


def open_items(items: DataFrame, column: str = "extra") -> DataFrame:
    """items with ``column``, JSON text, as VARIANT.

    Text that the strict reader refuses (NaN, say, or a key twice) stays whole as a
    string VARIANT, which has no fields; null stays null.
    """
    c = F.col(column)
    return items.withColumn(column, F.coalesce(F.try_parse_json(c), c.cast("variant")))


def field(v: Column, name: str) -> Column:
    """A top field as VARIANT: SQL null where it is absent, a VARIANT null where it is null."""
    return F.variant_get(v, _path(name), "variant")


def field_state(v: Column, name: str) -> Column:
    """``absent``, ``null`` or ``value``; a VARIANT that is no object, and SQL null, have no fields."""
    found = field(v, name)
    return F.when(found.isNull(), "absent").when(F.is_variant_null(found), "null").otherwise("value")


def typed_fields(items: DataFrame, fields: dict[str, str], column: str = "extra") -> DataFrame:
    """items with each field as a column of its type, null where it is absent, null or can't be cast, and ``<field>_state``.

    A value of another kind is told by a null beside the state ``value``.  Fields
    whose names items have already are an error.
    """
    new = [c for name in fields for c in (name, f"{name}_state")]
    if clash := set(new) & set(items.columns) or {c for c in new if new.count(c) > 1}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    c = F.col(column)
    typed = [(F.try_variant_get(c, _path(n), kind).alias(n), field_state(c, n).alias(f"{n}_state")) for n, kind in fields.items()]
    return items.select("*", *[x for pair in typed for x in pair])


def renamed_field(v: Column, old: str, new: str, kind: str = "string") -> Column:
    """Field ``new``, or ``old`` only where ``new`` is absent; a null ``new`` is null."""
    return F.when(field_state(v, new) == "absent", F.try_variant_get(v, _path(old), kind)).otherwise(F.try_variant_get(v, _path(new), kind))


def field_profile(items: DataFrame, column: str = "extra") -> DataFrame:
    """(field, n, n_null, kind) of all top fields: in how many items, null in how many, and the type that holds all its values.

    Keys of answers are open, so the profile stays a table and is summed before it is
    shuffled.  ``kind`` is VOID where all values are null, VARIANT where no type
    holds them all.
    """
    object_only = F.when(F.schema_of_variant(column).startswith("OBJECT<"), F.col(column))
    fields = items.select(object_only.alias("_v")).where("_v is not null").lateralJoin(_exploded(items.sparkSession))
    return fields.groupBy(F.col("key").alias("field")).agg(
        F.count("*").alias("n"), F.count_if(F.is_variant_null("value")).alias("n_null"), F.schema_of_variant_agg("value").alias("kind")
    )


def _exploded(spark) -> DataFrame:
    return spark.tvf.variant_explode(F.col("_v").outer()).select("key", "value")
