"""Moving many small (key, value) entries through a shuffle as packed arrays, a row for each bucket and batch.

A row of 8 bytes costs far more in the shuffle than 8 bytes in an array, so entries are dealt to buckets by their
hash on the map side and a bucket is sorted as one array on the reduce side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .shared import partitions

#: Entries that a map task holds before it sends them.
FLUSH = 1 << 20


def bucket_count(spark: SparkSession) -> int:
    """Four buckets for each shuffle partition, so that buckets shrink as a deployment adds partitions."""
    return 4 * partitions(spark)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


class Packer:
    """Collects parallel arrays and turns them into rows (bucket, one binary for each array)."""

    def __init__(self, n_buckets: int, names: list[str]):
        self.n, self.names, self.held, self.count = n_buckets, names, [], 0

    def add(self, bucket: np.ndarray, *arrays: np.ndarray):
        """Yields a batch when enough is held."""
        if len(bucket):
            self.held.append((bucket, *arrays))
            self.count += len(bucket)
        if self.count >= FLUSH:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        self.held, self.count = [], 0
        order = np.argsort(cols[0], kind="stable")
        bucket = cols[0][order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        out = [pa.array(bucket[cuts], pa.int32())]
        for c in cols[1:]:
            out.append(pa.array([_planes(x) for x in np.split(c[order], cuts[1:])], pa.binary()))
        return pa.RecordBatch.from_arrays(out, names=["bucket", *self.names])

    def rest(self):
        if self.count:
            yield self.flush()


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: high bytes of small numbers then compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _values(data: np.ndarray, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(data.reshape(size, -1).T).view(dtype).ravel()


def unpack(table: pa.Table, name: str, dtype) -> np.ndarray:
    """The array that a binary column's rows make together."""
    return np.concatenate([_values(np.frombuffer(x.as_buffer(), np.uint8), dtype) for x in table.column(name)] or [np.zeros(0, dtype)])
