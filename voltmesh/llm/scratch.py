"""Tables in the folder that all executors share, and Arrow helpers for tasks."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder

#: Spark removes the shuffle files of a query when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables that cut lineage: a lost executor costs a read, not the jobs before it."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        """tidy: what was shuffled for a table goes once the table is written, and not when the driver's JVM happens to collect its garbage."""
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made, self.tidy = 0, tidy

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, was = self.path(name), self.spark.conf.get(_TIDY, None)
        if self.tidy:
            self.spark.conf.set(_TIDY, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.unset(_TIDY) if was is None else self.spark.conf.set(_TIDY, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark remove the shuffle files of frames that are gone: what has been saved is not computed again."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a saved table that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        mine = self.root.rpartition("/")[2]
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if mine in folder:
                where = jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(conf).delete(where, True)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column behind each other, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n, (_, offsets, data) = len(column), column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row. After each, Arrow gives back what it holds in reserve: a
    worker that waits for its next task else keeps what its largest batch took."""
    pool = pa.default_memory_pool()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start)
            pool.release_unused()
            start = end


def strings(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array over bytes that already lie behind each other."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
