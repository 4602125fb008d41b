"""A table that many runs append to, the first row of each key kept; a repeated batch changes nothing.

Rows lie in a folder for each run and batch, and count once the batch stands in the
ledger, which is written last: a batch that was cut off is written anew, one that
ended is left alone.  Each batch leaves a Bloom filter of its keys, of one size for
all, so filters of any number of batches are or-ed into one.  Keys that it doesn't
know are new; only the others are looked for among earlier rows, of which no more
than the key is read.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..shared import shared_path

#: Bits of a filter, a power of two from 2^15 on.  The or of all filters goes to the workers, an eighth of this in
#: bytes; with more keys it knows too many, which costs time and is never wrong.
FILTER_BITS = 1 << 26
_HASHES = 4
_PIECE = 1 << 15  # bits of one of Spark's bitmaps


def _places(key: Column, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(n)), F.lit(bits)) for n in range(_HASHES)])


def bloom(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """(piece, bitmap): the filter of a column in pieces, built by partial aggregates; filters merge by ``merged``."""
    place = keys.select(F.explode(_places(F.col(key), bits)).alias("place"))
    # bitmaps count from 1
    return place.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bitmap"))


def merged(filters: DataFrame) -> DataFrame:
    return filters.groupBy("piece").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def may_hold(filters: DataFrame, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test of a key column against the merged filters; false says that no filter has the key.

    The merged filter, bits / 8 bytes however many keys it has, is collected and broadcast.
    """
    table = np.zeros(bits // 8, np.uint8)
    for r in merged(filters).toLocalIterator():
        at = (r.piece - 1) * (_PIECE // 8)
        table[at : at + _PIECE // 8] = np.frombuffer(r.bitmap, np.uint8)
    shared = filters.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def known(places: pa.Array) -> pa.Array:
        p = places.flatten().to_numpy(zero_copy_only=False).reshape(-1, _HASHES)
        return pa.array((shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).all(axis=1))

    return lambda key: known(_places(key, bits))


class AppendTable:
    """A table under ``path`` whose rows are told apart by ``key``; of equal keys the first stays.

    Earlier batches come first, in a batch the least by ``order``, then by all columns.
    Keys with nulls are keys like any other; an empty batch stands in the ledger and
    adds nothing.  ``_key``, ``run`` and ``batch`` are names of its own.
    """

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], order: tuple[str, ...] = (), bits: int = FILTER_BITS):
        if bits < _PIECE or bits & (bits - 1):
            raise ValueError("bits must be a power of two from 32768 on")
        self.spark, self.path, self.key, self.order, self.bits = spark, path.rstrip("/"), key, order, bits

    def _folder(self, kind: str, run: str, batch: int) -> str:
        return f"{self.path}/{kind}/run={run}/batch={batch}"

    def _file(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def has(self, run: str, batch: int) -> bool:
        """Whether the batch is in the ledger."""
        fs, place = self._file(self._folder("ledger", run, batch) + "/_SUCCESS")
        return fs.exists(place)

    def _read(self, kind: str, schema: str, but: tuple[str, int] | None = None) -> DataFrame | None:
        """Rows of a kind that belong to batches in the ledger; files of the batch ``but`` aren't even listed in the plan."""
        fs, place = self._file(f"{self.path}/ledger")
        if not fs.exists(place):
            return None
        # a batch without rows of its own still has its folder; one that was cut off has no entry
        ledger = self.spark.read.schema("n long, run string, batch long").parquet(f"{self.path}/ledger").select("run", "batch").distinct()
        found = self.spark.read.schema(f"{schema}, run string, batch long").parquet(f"{self.path}/{kind}")
        if but:
            found = found.where((F.col("run") != but[0]) | (F.col("batch") != but[1]))
        return found.join(ledger, ["run", "batch"], "left_semi")

    def rows(self, schema: str) -> DataFrame:
        """All rows that count, with run and batch; ``schema`` names the columns of a row."""
        found = self._read("rows", schema)
        return self.spark.createDataFrame([], f"{schema}, run string, batch long") if found is None else found.select(*[c for c in found.columns if c not in ("run", "batch")], "run", "batch")

    def append(self, rows: DataFrame, run: str, batch: int) -> bool:
        """Adds the rows of new keys; false if the batch had been added before, which is no error."""
        if clash := {"_key", "run", "batch"} & set(rows.columns):
            raise ValueError(f"columns {sorted(clash)} are the table's own")
        if not run or set(run) & set("/=%:"):
            raise ValueError("a run is named by a plain word")
        if self.has(run, batch):
            return False
        digest = F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(self.key)]), {"ignoreNullFields": "false"}), 256)
        rest = [c for c in rows.columns if c not in self.order]
        first = rows.select(digest.alias("_key"), F.struct(*self.order, *rest).alias("_row")).groupBy("_key").agg(F.min("_row").alias("_row"))
        first, scratch = first.select("_key", *[F.col(f"_row.`{c}`").alias(c) for c in rows.columns]), shared_path(self.spark, "append")
        first.write.parquet(scratch)
        first = self.spark.read.schema(first.schema).parquet(scratch)
        earlier = self._read("blooms", "piece long, bitmap binary", (run, batch))
        new = first
        if earlier is not None:
            # before the join the test is a column, so that it runs once a row
            asked = first.withColumn("_known", may_hold(earlier, self.bits)(F.col("_key")))
            seen = self._read("rows", "_key string", (run, batch)).join(asked.where("_known").select("_key"), "_key", "left_semi").select("_key")
            new = first.join(seen, "_key", "left_anti") if not asked.where("_known").isEmpty() else first
        # overwrites what a batch that was cut off has left
        new.write.mode("overwrite").parquet(self._folder("rows", run, batch))
        kept = self.spark.read.schema("_key string").parquet(self._folder("rows", run, batch))
        bloom(kept, "_key", self.bits).write.mode("overwrite").parquet(self._folder("blooms", run, batch))
        kept.agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(self._folder("ledger", run, batch))
        fs, place = self._file(scratch)
        fs.delete(place, True)
        return True

    def sink(self, stream: DataFrame, run: str) -> DataStreamWriter:
        """A writer of the stream's micro-batches; ``run`` names the stream and its checkpoint for good."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.append(rows, run, batch) and None)
