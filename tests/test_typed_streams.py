import time

import pytest

from scriptorium.config import LOCAL
from scriptorium.operators import chunking
from scriptorium.streaming.typed_chunks import rocksdb, stream_chunks_typed

SCHEMA = "doc_id long, page_no int, text string, is_last boolean"


class Stream:
    """Batches written one after another; each run is a restart from the checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options
        (folder / "in").mkdir()

    def take(self, *rows):
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        pages = self.spark.readStream.schema(SCHEMA).parquet(str(self.folder / "in"))
        with rocksdb(self.spark):
            stream_chunks_typed(pages, LOCAL, **self.options).writeStream.format("parquet").option("checkpointLocation", str(self.folder / "state")).outputMode("append").trigger(once=True).start(str(self.folder / "out")).awaitTermination(90)
        return self.found()

    def found(self):
        return sorted(map(tuple, self.spark.read.schema("doc_id long, chunk_id int, chunk_text string").parquet(str(self.folder / "out")).collect()))


@pytest.fixture
def stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    return lambda **options: Stream(spark, tmp_path, **options)


def test_gaps_restarts_repeats_and_late_pages(spark, stream):
    s = stream()
    page = lambda k: f"Page {k} has words。 " * 40
    assert s.take((1, 2, page(2), False), (2, 0, page(9), False)) == []  # a gap before, and too little for a chunk
    some = s.take((1, 0, page(0), False), (2, 1, None, True))
    assert {r[0] for r in some} == {2}
    whole = s.take((1, 1, page(1), False), (1, 3, page(3), True), (2, 2, "too late", False))
    pages = [(1, k, page(k)) for k in range(4)] + [(2, 0, page(9))]
    want = chunking.chunk_pages(spark.createDataFrame(pages, "doc_id long, page_no int, text string"), LOCAL).select("doc_id", "chunk_id", "chunk_text")
    assert whole == sorted(map(tuple, want.collect()))
    assert s.take((1, 4, "behind the end", True)) == whole


def test_idle_documents_end(spark, stream):
    s = stream(idle_s=1, keep_s=3600)
    assert s.take((1, 0, "First page。", False), (1, 2, "behind a gap", False)) == []
    time.sleep(1.5)
    assert s.take((7, 0, "Other。", True)) == [(1, 0, "First page。\nbehind a gap"), (7, 0, "Other。")]
    assert len(s.take((1, 1, "late", True))) == 2
