"""Helpers that the operators share: the shared folder, written intermediate tables, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at a time; a longer document is handled alone.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests), a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jsc = spark.sparkContext._jsc.sc()
        found = jsc.getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(path)
        return jsc.getCheckpointDir().get()
    return path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written tables that nothing lazy needs any more."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dealt(df: DataFrame) -> DataFrame:
    """df for a join with a large table by shuffle at every size, whatever its own size.

    A broadcast at small sizes alone would make small runs tell nothing about large ones.
    """
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small, whatever the number of rows in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def carried(docs: DataFrame, *used: str) -> DataFrame:
    """docs with its other columns in one column rest, so that none of their names can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.withColumn("rest", F.struct(*others) if others else F.struct(F.lit(None).alias("none")))


def uncarried(df: DataFrame, docs: DataFrame, **own: Column) -> DataFrame:
    """df's own columns and those in rest, in the order of docs's columns."""
    return df.select(*[own[c].alias(c) if c in own else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES):
    """Each batch in slices of at most limit bytes of text, or of one document: (slice, bytes, offsets)."""
    for batch in batches:
        buf, offs = texts_of(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the size of each row's list."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
