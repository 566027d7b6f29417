"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of a word in the contracts: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RX = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark whatever the store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, _UPPER, _UPPER.lower())


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            found = at.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            found = tempfile.mkdtemp(prefix="lodestream-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/lodestream/{what}-{uuid.uuid4().hex}"


class Written:
    """A table written in the shared folder: its rows outlive executors, and its lineage is a file scan."""

    def __init__(self, df: DataFrame, what: str = "table"):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, what)
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str = "table") -> DataFrame:
    return Written(df, what).df


def small(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose column (strings or lists) holds about most bytes or values, one row at least.

    Slices share their batch's memory; what is made of a slice is small even where a batch of long texts isn't."""
    for b in batches:
        c = b.column(column)
        wide = pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type) or pa.types.is_large_list(c.type)
        ends = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) if len(c) else np.zeros(1, np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def tidy(run):
    """run, a function over batches, that gives its memory back when a task ends: workers live on between tasks, and
    what an idle one holds is missing elsewhere."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return inner
