"""Training examples from tagged text, their shapes and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tags import entities_of

#: Fixed value: the instruction of every example.
INSTRUCTION = "你是明朝歷史資料專家。請從以下文本中提取官員資訊，輸出為 JSON List。"


def spaced_json(entities: Column) -> Column:
    """Entities as JSON with a blank after commas and colons, fields in order, null rank left out."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)

    def one(e: Column) -> Column:
        rank = F.when(e["rank"].isNotNull(), F.concat(F.lit('"rank": '), quoted(e["rank"]), F.lit(", "))).otherwise("")
        return F.concat(F.lit('{"name": '), quoted(e["name"]), F.lit(", "), rank, F.lit('"event_type": '), quoted(e["event_type"]), F.lit(', "action": '), quoted(e["action"]), F.lit("}"))

    return F.concat(F.lit("["), F.array_join(F.transform(entities, one), ", "), F.lit("]"))


def training_examples(tagged: DataFrame, text: str = "text_content") -> DataFrame:
    """tagged with instruction, input and output; only texts with an entity."""
    d = entities_of(tagged, text).where(F.size("entities") > 0)
    return d.select(*tagged.columns, F.lit(INSTRUCTION).alias("instruction"), F.col("clean").alias("input"), spaced_json(F.col("entities")).alias("output"))


def prompt_completion(examples: DataFrame) -> DataFrame:
    """examples with text and completion in place of instruction, input and output; a null field is an error."""
    sure = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"an example has no {c}"))).otherwise(F.col(c))
    rest = [c for c in examples.columns if c not in ("instruction", "input", "output")]
    return examples.select(*rest, F.concat(sure("instruction"), F.lit("\n\n"), sure("input")).alias("text"), sure("output").alias("completion"))


def _shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))


def shuffled(examples: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order that depends on their key and the seed only."""
    return examples.orderBy(_shuffle_key(key, seed), key)


def split(examples: DataFrame, key: str, seed: int = 42, share: float = 0.9, leak_free: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, valid, test).

    The last int(n * share) .. n rows in shuffled order are valid and test.  Train
    has all rows; with ``leak_free`` it lacks those of valid.
    """
    ranked = split_ranks(examples, key, seed)
    first = F.col("place") <= F.col("cut")
    valid = ranked.where(~first).drop("place", "cut")
    train = ranked.where(first).drop("place", "cut") if leak_free else examples
    return train, valid, valid


def split_ranks(examples: DataFrame, key: str, seed: int = 42, share: float = 0.9) -> DataFrame:
    """examples with place (1 to n in shuffled order) and cut (int(n * share)).

    Places come from buckets of the shuffle key: counts before each bucket, and a
    row number inside it, so that no task sees all rows.
    """
    d = examples.withColumn("_k", _shuffle_key(key, seed)).withColumn("_b", F.substring("_k", 1, 3))
    counts = d.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_k", key)) + F.col("_before")
    # at most 4,096 buckets
    d = d.join(F.broadcast(before), "_b").withColumns({"place": place, "cut": (F.col("_all") * F.lit(share).cast("double")).cast("long")})
    return d.select(*examples.columns, "place", "cut")


def convert_script(text: Column, pairs: dict[str, str]) -> Column:
    """Characters replaced one by one; a pair of anything but one character and at most one is an error."""
    if bad := [k for k, v in pairs.items() if len(k) != 1 or len(v) > 1]:
        raise ValueError(f"not single characters: {bad}")
    # the replaced without a replacement go last, as the shorter list has no partner for them
    pairs = {k: v for k, v in pairs.items() if v} | {k: v for k, v in pairs.items() if not v}
    return F.translate(text, "".join(pairs), "".join(pairs.values()))
