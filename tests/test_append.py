import random

import pytest
from pyspark.sql import functions as F

from scriptorium.sources.append import AppendTable, bloom, may_hold, merged

ROW = "name string, quote string, n long"


def by_hand(batches):
    """The rows of first keys over batches in their order."""
    out = {}
    for batch in batches:
        for r in sorted(batch, key=lambda r: r[2]):
            out.setdefault(r[:2], r)
    return sorted(out.values(), key=repr)


def rows_of(table):
    return sorted((tuple(r[:3]) for r in table.rows(ROW).collect()), key=repr)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_first_of_each_key_over_runs(spark, tmp_path, bits):
    rng = random.Random(bits)
    # with few bits thousands of keys fill the filter, and the join alone decides
    name = lambda: rng.choice([None, "", "hot", *(f"k{rng.randrange(8000)}" for _ in range(8))])
    batches = [[(name(), rng.choice([None, "q"]), k * 10_000 + n) for n in range(size)] for k, size in enumerate((3000, 0, 2500))]
    table = AppendTable(spark, str(tmp_path / "t"), ("name", "quote"), ("n",), bits)
    assert table.rows(ROW).collect() == []
    for k, batch in enumerate(batches):
        d = spark.createDataFrame(batch, ROW)
        assert table.append(d, "daily", k) and table.has("daily", k)
        # again, even with other rows: nothing changes
        assert not table.append(d.withColumn("name", F.lit("other")), "daily", k)
        assert rows_of(table) == by_hand(batches[: k + 1])
    again = AppendTable(spark, str(tmp_path / "t"), ("name", "quote"), ("n",), bits)
    assert again.append(spark.createDataFrame([("new", None, 1), ("hot", "q", -1), ("new", None, 0)], ROW), "other", 0)
    assert rows_of(again) == by_hand([*batches, [("new", None, 0)]])
    assert again.rows(ROW).where("name = 'new'").select("run", "batch").collect() == [("other", 0)]


def test_a_batch_that_was_cut_off_is_written_anew(spark, tmp_path):
    table = AppendTable(spark, str(tmp_path / "t"), ("name",), ("n",), 1 << 15)
    d = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], ROW)
    table.append(d.where("name = 'a'"), "r", 0)
    table.append(d, "r", 1)
    # rows and filter are there, the entry isn't
    fs, place = table._file(table._folder("ledger", "r", 1))
    fs.delete(place, True)
    assert rows_of(table) == [("a", "x", 1)]
    assert table.append(d, "r", 1) and rows_of(table) == [("a", "x", 1), ("b", "x", 2)]


def test_filters_merge_and_miss_nothing(spark):
    bits = 1 << 17
    a, b = (spark.range(*span).select(F.col("id").cast("string").alias("key")) for span in ((0, 3000), (2000, 6000)))
    both = bloom(a, "key", bits).unionByName(bloom(b, "key", bits))
    known = may_hold(both, bits)
    assert a.union(b).where(~known(F.col("key"))).count() == 0
    assert spark.range(10_000, 30_000).where(known(F.col("id").cast("string"))).count() < 600
    whole = {r.piece: bytes(r.bitmap) for r in bloom(a.union(b), "key", bits).collect()}
    assert {r.piece: bytes(r.bitmap) for r in merged(both).collect()} == whole
    assert a.where(may_hold(both.limit(0), bits)(F.col("key"))).count() == 0


def test_a_stream_that_restarts_adds_each_row_once(spark, tmp_path):
    table = AppendTable(spark, str(tmp_path / "t"), ("name",), ("n",), 1 << 15)
    source = str(tmp_path / "in")

    def run(checkpoint):
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
        table.sink(stream, "live").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    for k in range(2):
        spark.createDataFrame([("a", "x", k), (f"b{k}", "x", k)], ROW).coalesce(1).write.mode("append").parquet(source)
        run("c")
    want = [("a", "x", 0), ("b0", "x", 0), ("b1", "x", 1)]
    assert rows_of(table) == want
    # the checkpoint is lost: the batches come again under their numbers
    run("lost")
    assert rows_of(table) == want


def test_what_a_table_refuses(spark, tmp_path):
    with pytest.raises(ValueError, match="power of two"):
        AppendTable(spark, str(tmp_path), ("name",), bits=1000)
    table = AppendTable(spark, str(tmp_path / "t"), ("name",))
    d = spark.createDataFrame([("a", 1)], "name string, run int")
    with pytest.raises(ValueError, match="own"):
        table.append(d, "r", 0)
    with pytest.raises(ValueError, match="plain word"):
        table.append(d.drop("run"), "a/b", 0)
