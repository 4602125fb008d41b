"""Where intermediate tables go, and settings that bound a Python worker's batches."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shared import give_back


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder ``spark.checkpoint.dir``; a temporary one only where it is unset on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", folder)
    # with its scheme, so that Spark and other readers take the same file system
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[id(out)] = path
    weakref.finalize(out, _folders.pop, id(out), None)
    return out


_folders: dict[int, str] = {}
#: Seconds between two collections in a driver whose heap is too large to fill up by itself.
COLLECT_S = 30
_collected = 0.0


def release(*tables: DataFrame) -> None:
    """Delete the folders of tables from ``materialise`` that no later step reads, and let Spark drop dead shuffles."""
    for table in tables:
        spark, path = table.sparkSession, _folders.pop(id(table))
        whole = spark._jvm.org.apache.hadoop.fs.Path(path)
        whole.getFileSystem(spark._jsc.hadoopConfiguration()).delete(whole, True)
    global _collected
    if tables and time.monotonic() - _collected > COLLECT_S:
        # shuffle files go when the driver collects the plans that made them
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()
        _collected = time.monotonic()


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches: documents vary from a word to megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that leaves its Python worker small: the worker stays for the next stages' tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
