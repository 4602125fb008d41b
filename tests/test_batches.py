"""Python workers turn whole Arrow batches into objects, so operators over texts keep batches small."""

import pytest
from pyspark.sql import functions as F

from scriptorium.config import LOCAL
from scriptorium.operators import chunking
from scriptorium.plans import pipelines


@pytest.fixture
def texts(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    yield spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("page_no"), F.lit("Some text of it. ").alias("text"))
    assert spark.conf.get(name) == "512"
    spark.conf.set(name, before)


def test_chunks(texts):
    assert chunking.chunk_documents(texts, LOCAL).count() == 3000


def test_chunks_of_pages(texts):
    assert chunking.chunk_pages(texts, LOCAL).count() == 3000


def test_rule_extraction(texts):
    assert pipelines.rule_extraction(texts).count() == 3000


def test_segments(texts):
    from scriptorium.operators import segments

    d = texts.select("doc_id", F.lit(0).alias("chunk_id"), F.lit("head ○ one ○ two").alias("chunk_text"))
    assert segments.marker_segments(d, enabled=True).count() == 3000


def test_phrases(texts):
    from scriptorium.operators import phrases

    found = phrases.find_phrases(texts, {"text": "T", "of it": "O"}, "f")
    assert found.where("f[0].at = 5 and f[1].replacement = 'O' and size(f) = 2").count() == 3000
    assert phrases.find_phrases(texts.withColumn("text", F.lit(None).cast("string")), {"a": "b"}, "f").where("size(f) = 0").count() == 3000


def test_json_lines(texts, tmp_path):
    from scriptorium.sources import readers

    texts.select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(str(tmp_path / "lines"))
    assert readers.jsonl(texts.sparkSession, str(tmp_path / "lines"), "doc_id long, text string").count() == 3000
