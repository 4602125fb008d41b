"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import read_table


def _fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(read_table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_turns, read_back

    control = spark.sql("select -1L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text union all select -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return read_back(format_turns(rows))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import score_quality

    labels = read_table(spark, sf_dir, "labels").where(_fold(5) != 0)
    return score_quality(read_table(spark, sf_dir, "documents"), labels).select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_texts

    d = score_texts(read_table(spark, sf_dir, "documents"), _fold(5) != 1)
    return d.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict, train

    documents = read_table(spark, sf_dir, "documents")
    model = train(documents.where(_fold(4) != 2))
    return predict(documents, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE_KINDS, find_personal_data, joined

    d = find_personal_data(read_table(spark, sf_dir, "documents"))
    kinds = F.col("base.kind")
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return d.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))[0]


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import infill, restore

    d = infill(read_table(spark, sf_dir, "documents"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    restored = restore(F.col("output"), F.col("form"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damage, repair, repaired_text

    conversations = read_table(spark, sf_dir, "conversations")
    d = repair(damage(conversations), conversations.select("conv_id"))
    return d.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(repaired_text("repaired").cast("binary"), 256).alias("repaired_sha256"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {"op1_quality_rules": oracles.quality_rules(), "op5_chat_formatting": oracles.CHAT, "op7_minhash_near_dedup": oracles.NEAR_DUPLICATES, "op12_fill_in_middle": oracles.INFILL, "op13_conversation_repair": oracles.REPAIR}
