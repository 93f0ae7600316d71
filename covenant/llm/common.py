"""Pieces the training-data operators share.

``stored`` cuts a lineage by writing a Parquet table below the shared folder
(``spark.checkpoint.dir``): unlike cached blocks it survives lost executors,
and reads of it prune columns. ``text_chunks`` cuts Arrow batches into runs of
rows of bounded size, so that the work of a Python task is bounded by the
chunk (or by a single text when that is longer).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from covenant.session import shared_path

CHUNK_BYTES = 1 << 18
CHUNK_ROWS = 1024
_WRITTEN: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    path = shared_path(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete every table written by ``stored`` in this process; call it once
    the results that read them have been consumed."""
    jvm, n = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def small_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """Bound the Arrow batches of this session, so that a Python worker and the JVM's buffers for it hold
    little of a table of whole texts at once. Smaller bounds that are set already stay."""
    for key, bound in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).removesuffix("b")
        now = int(now) if now.lstrip("-").isdigit() else 0      # a size with another unit is set anew
        if not 0 < now <= bound:
            spark.conf.set(key, str(bound))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES,
                rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``rows`` rows and ``limit`` bytes of text (or one row)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        i, n = 0, batch.num_rows
        while i < n:
            base = ends[i - 1] if i else 0
            j = min(max(i + 1, int(np.searchsorted(ends, base + limit, side="right"))), i + rows, n)
            yield batch.slice(i, j - i)
            i = j


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = 8 if pa.types.is_large_string(column.type) else 4
    _, off, data = column.buffers()
    n = len(column)
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide == 8 else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def batch_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def int_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose row i holds the next ``counts[i]`` of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
