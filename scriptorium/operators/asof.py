"""As-of look-up: each row gets the nearest earlier row of another table with the same key.

A key may hold any share of all rows, so its positions are cut into blocks that are
windows of their own.  What a block must know of those before it is carried into it:
with a tolerance the rows less than the tolerance before its start, by the same
shuffle; without one the last row before it, from one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block; one task holds the rows of one block at least.
BLOCK = 1 << 16


def _all_known(columns: list[Column]) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return known


def latest(events: DataFrame, tolerance: int | None = None, block: int = BLOCK) -> DataFrame:
    """(l, r) for each event with ``l``: the r of the event before it.

    events(k, at, o, l, r): a key, a long position, an order among events with r at
    one position, and one of the structs l (that looks) and r (that is looked up).
    An event with r is seen at its own position already; the last by ``o`` counts.
    """
    if tolerance is not None and not 0 <= tolerance <= block:
        raise ValueError(f"tolerance {tolerance} is not between 0 and the block of {block} positions")
    of, looks = F.floor(F.col("at") / block).cast("long"), F.col("l").isNotNull()
    side = F.when(looks, 1).otherwise(0).alias("side")
    if tolerance is None:
        d = events.select("k", of.alias("b"), "at", side, "o", "l", "r")
        last = d.groupBy("k", "b").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.struct("at", "o"))).alias("r"), F.max("side").alias("side"))
        before = F.last("r", ignorenulls=True).over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        carried = last.select("k", "b", "side", before.alias("r")).where("side = 1 and r is not null")
        # the order by position comes first, so what is carried has none
        none = lambda c: F.lit(None).cast(d.schema[c].dataType).alias(c)
        d = d.unionByName(carried.select("k", "b", none("at"), F.lit(0).alias("side"), none("o"), none("l"), "r"))
    else:
        near_end = ~looks & ((of + 1) * block - F.col("at") <= tolerance)
        d = events.select("k", F.explode(F.when(near_end, F.array(of, of + 1)).otherwise(F.array(of))).alias("b"), "at", side, "o", "l", "r")
    w = Window.partitionBy("k", "b").orderBy(F.asc_nulls_first("at"), "side", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("r", F.last("r", ignorenulls=True).over(w)).where("l is not null").select("l", "r")


def asof(
    left: DataFrame, right: DataFrame, by: tuple[str, ...], left_at: str, right_at: str, take: dict[str, str], tolerance: int | None = None, block: int = BLOCK
) -> DataFrame:
    """left with columns ``take`` ({of right: new name}) of the nearest right row at or before it, at most ``tolerance`` before.

    Positions are whole numbers.  Of right rows at one position the greatest by the
    taken columns counts, nulls least.  Left rows with a null key or position, and
    those without a match, keep nulls; right rows with one match nothing.  Repeated
    left rows each stay; no other column of the right one comes along, whatever its name.
    """
    if clash := set(take.values()) & set(left.columns):
        raise ValueError(f"left has columns {sorted(clash)} already")
    key = lambda: F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(by)]).alias("k")
    taken = F.struct(F.col(right_at).cast("long").alias("at"), *[F.col(c).alias(f"t{n}") for n, c in enumerate(take)])
    row = F.struct(F.col(left_at).cast("long").alias("at"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))
    usable = lambda at: _all_known([F.col(c) for c in (*by, at)])
    found = right.where(usable(right_at)).select(key(), F.col(right_at).cast("long").alias("at"), taken.alias("o"), taken.alias("r"))
    asked = left.where(usable(left_at)).select(key(), F.col(left_at).cast("long").alias("at"), row.alias("l"))
    both = asked.withColumn("o", F.lit(None).cast(found.schema["o"].dataType)).withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    both = both.unionByName(found.withColumn("l", F.lit(None).cast(asked.schema["l"].dataType)))
    out = latest(both, tolerance, block)
    near = F.lit(True) if tolerance is None else F.col("l.at") - F.col("r.at") <= tolerance
    out = out.select("l.row.*", *[F.when(near, F.col(f"r.t{n}")).alias(name) for n, name in enumerate(take.values())])
    types = {f.name: f.dataType for f in out.schema.fields}
    rest = left.where(~usable(left_at)).select(*[F.col(f"`{c}`") for c in left.columns], *[F.lit(None).cast(types[c]).alias(c) for c in take.values()])
    return out.unionByName(rest)
