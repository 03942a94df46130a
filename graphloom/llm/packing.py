"""Best-fit packing of documents into sequences of fixed length, in bulk-synchronous rounds.

Pieces and gaps are both sorted by counting: a piece's place in the range sort is its length and its rank among
pieces of that length, dealt out over tasks by prefix sums of per-task counts. A round takes the longest length
left and sweeps its pieces over their successors, the smallest gaps that hold them; pieces that want the same gap
are told apart by rank, gaps shrink, and the round repeats until its pieces are placed. What the rounds need is
a count for each length, never rows: at most max_tokens counts, whatever the input. They return runs (length,
ranks, sequences, offset), and each piece looks up its own run in the executors.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import automaton
from .shared import dealt, materialize, small_batches, text_chunks
from .wordcache import LONGEST, Cache

#: Words and pre-split words that a worker keeps.
WORDS, PARTS = 400_000, 300_000


class _Encoder:
    """Ids of a chunk's words as little-endian unsigned 32-bit integers; each different word is looked up once a chunk.

    Words are known by their 64-bit hashes; a process keeps WORDS of up to LONGEST bytes.
    """

    def __init__(self, path: str):
        self.automaton, self.known = automaton(path), {}
        self.code = [i.to_bytes(4, "little") for i in range(max(self.automaton.labels) + 1)]
        self.parts = Cache(lambda w: b"".join([self.code[i] for i in self.automaton.encode_word(w)]), PARTS)

    def word(self, word: bytes) -> bytes:
        return b"".join([self.code[w] if isinstance(w, int) else self.parts[w] for w in self.automaton.split(word.decode())])

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's documents, one after the other, and how many each has."""
        start, end, doc = K.words(buf, offs)
        hashes, at, which = np.unique(K.span_hashes(buf, start, end), return_index=True, return_inverse=True)
        data, known, found = buf.tobytes(), self.known, []
        for h, a, b in zip(hashes.tolist(), start[at].tolist(), end[at].tolist(), strict=True):
            if (ids := known.get(h)) is None:
                ids = self.word(data[a:b])
                if len(known) < WORDS and b - a <= LONGEST:
                    known[h] = ids
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, flat, many = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4"), size[which]
        place = np.repeat(first[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return flat[place], np.bincount(doc, weights=many, minlength=len(offs) - 1).astype(np.int64)


@lru_cache(2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _cut(path: str, most: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]):
        encode, task = _encoder(path), TaskContext.get().partitionId()
        seen, end = np.zeros(most + 1, np.int64), end_id.to_bytes(4, "little")
        for batch, buf, offs in text_chunks(batches):
            flat, many = encode(buf, offs)
            data, cuts, rows = flat.tobytes(), np.concatenate([[0], np.cumsum(many)]).tolist(), []
            for i, a, b in zip(batch.column("id").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                ids = data[4 * a : 4 * b] + end
                for k, at in enumerate(range(0, len(ids), 4 * most)):
                    x = ids[at : at + 4 * most]
                    rows.append((i, k, at // 4, len(x) // 4, zlib.crc32(x), seen[len(x) // 4]))
                    seen[len(x) // 4] += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*out, pa.array([task] * len(rows), pa.int32())], names=["id", "piece", "start", "length", "ids_crc32", "local", "task"])

    return run


def best_fit(counts: dict[int, int], most: int) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, offset), sorted; counts: pieces of each length."""
    runs: list[tuple[int, int, int, int, int]] = []
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    gaps: list[int] = []
    sequences = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_at:
                open_at[gap] = []
                bisect.insort(gaps, gap)
            open_at[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = open_at[gap].pop()
                if not open_at[gap]:
                    del open_at[gap]
                    gaps.pop(at)
            else:
                gap, first = most, sequences
                n = -(-left // (most // length))
                sequences += n
            fits = gap // length
            used = min(n, -(-left // fits))
            put(gap, first + used, n - used)
            offset, here = most - gap, used
            for _ in range(fits):
                take = min(here, left)
                if take < here:
                    put(most - offset, first + take, here - take)
                if not take:
                    here = 0
                    break
                runs.append((length, rank, take, first, offset))
                left, rank, offset, here = left - take, rank + take, offset + length, take
            put(most - offset, first, here)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        runs = shared.value
        key = runs[:, 0] * (1 << 48) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            r = runs[np.searchsorted(key, length * (1 << 48) + rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            keep = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(r[:, 3] + rank - r[:, 1], pa.int64()), pa.array(r[:, 4], pa.int64())], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of docs.

    A document is its ids and then end_id; only longer ones are cut. A null or empty text is end_id alone. Repeated
    rows, null ids and ties are packed like any others; other columns are ignored; an empty table gives no rows. path: a
    vocabulary file that every executor can open.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = src.mapInArrow(_cut(path, max_tokens, end_id), "id long, piece int, start long, length long, ids_crc32 long, local long, task int")
    pieces = materialize(pieces, "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_tokens rows
    runs = spark.sparkContext.broadcast(best_fit(counts, max_tokens))
    ranked = pieces.join(dealt(base), ["length", "task"]).withColumn("rank", F.col("base") + F.col("local"))
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(runs), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
