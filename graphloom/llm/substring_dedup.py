"""Substring dedup by level-wise doubling: windows that repeat at one length alone are looked at at twice that length.

The base level hashes windows of base words. Not all: each window of 2 * base words names the base window in it with
the smallest hash, and only named ones (about one in six) are compared; equal windows name theirs at the same place,
so none is lost. A window of twice the length goes on only if the base window it names is repeated, and one of each
later length only if both its halves are. At the last length the first of equal windows, by (id, start), stays and
the words that the others cover go. No level has candidates that the level before didn't leave.

A map task sends a hash once, however often its rows have it: further copies are known to be repeated without the
shuffle. A passage that a third of all documents share thus costs one entry for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .buckets import FLUSH, Packer, bucket_count, bucket_of, unpack
from .shared import dealt, small_batches, text_chunks

_ENTRY = ["hash", "ids", "at", "known"]
#: What an entry says: not known to repeat; known to, needs no comparison; sent only to inform others.
_OPEN, _KNOWN, _TOLD = 0, 1, 2


def named(h: np.ndarray, base: int, width: int) -> np.ndarray:
    """For each window of width words, where the base window with the smallest hash starts (the first, if several)."""
    grams = K.gram_hashes(h, base)
    if len(grams) < width - base + 1:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width - base + 1)
    return np.arange(len(view)) + view.argmin(1)


class _Sender:
    """Entries of a map task; equal hashes are settled before they are sent."""

    def __init__(self, buckets: int, first: bool):
        self.pack, self.first, self.buckets, self.held, self.count = Packer(buckets, _ENTRY), first, buckets, [], 0

    def add(self, bucket: np.ndarray, h: np.ndarray, ids: np.ndarray, at: np.ndarray):
        if len(h):
            self.held.append((bucket, h, ids, at))
            self.count += len(h)
        if self.count >= FLUSH:
            yield from self.settle()

    def settle(self):
        if not self.count:
            return
        bucket, h, ids, at = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.count = [], 0
        order = np.lexsort((at, ids, h)) if self.first else np.argsort(h, kind="stable")
        bucket, h, ids, at = bucket[order], h[order], ids[order], at[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        away = bucket_of(K.mix(ids.view(np.uint64)), self.buckets)
        if self.first:
            again = ~new & ((ids != ids[lead]) | (at != at[lead]))
            parts = [(new, bucket, _OPEN), (again, away, _KNOWN)]
        else:
            many = np.concatenate([~new[1:], [False]]) | ~new
            parts = [(~many, bucket, _OPEN), (many, away, _KNOWN), (many & new, bucket, _TOLD)]
        for mask, to, what in parts:
            yield from self.pack.add(to[mask], h[mask], ids[mask], at[mask].astype(np.int32), np.full(int(mask.sum()), what, np.int8))

    def rest(self):
        yield from self.settle()
        yield from self.pack.rest()


def _repeats(first: bool):
    def run(table: pa.Table) -> pa.Table:
        h, ids, at, known = (unpack(table, n, t) for n, t in zip(_ENTRY, (np.uint64, np.int64, np.int32, np.int8), strict=True))
        sure, told = known == _KNOWN, known == _TOLD
        h, oid, oat, told = h[~sure], ids[~sure], at[~sure], told[~sure]
        order = np.lexsort((oat, oid, h))
        h, oid, oat, told = h[order], oid[order], oat[order], told[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        if first:
            lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else new
            out = (oid != oid[lead]) | (oat != oat[lead]) if len(h) else new
        else:
            out = (~new | np.concatenate([~new[1:], [False]])) & ~told if len(h) else new
        ids, at = np.concatenate([ids[sure], oid[out]]), np.concatenate([at[sure], oat[out]])
        order = np.lexsort((at, ids))
        ids, at = ids[order], at[order]
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
        at = [x.tobytes() for x in np.split(at, cuts[1:])] if len(ids) else []
        return pa.table({"id": pa.array(ids[cuts], pa.int64()), "at": pa.array(at, pa.binary())})

    return run


def _ids_and_base(batch: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray):
    s, e, doc = K.words(buf, offs)
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))])
    return K.span_hashes(buf, s, e), doc, first, batch.column("id").to_numpy(zero_copy_only=False)


def _base_level(base: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]):
        send = _Sender(buckets, False)
        for batch, buf, offs in text_chunks(batches):
            h, doc, first, ids = _ids_and_base(batch, buf, offs)
            at = named(h, base, 2 * base)
            at = np.unique(at[K.inside(doc, 2 * base)[: len(at)]])
            g = K.gram_hashes(h, base)[at] if len(at) else np.zeros(0, np.uint64)
            yield from send.add(bucket_of(g, buckets), g, ids[doc[at]], at - first[doc[at]])
        yield from send.rest()

    return run


def _flat(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Each row's word positions."""
    return [np.frombuffer(b"".join(x or []), np.int32).astype(np.int64) for x in batch.column("at").to_pylist()]


def _next_level(base: int, width: int, last: bool, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]):
        send = _Sender(buckets, last)
        for batch, buf, offs in text_chunks(batches):
            h, doc, first, ids = _ids_and_base(batch, buf, offs)
            hit = np.zeros(len(h) + 1, bool)
            for d, x in enumerate(_flat(batch)):
                hit[x + first[d]] = True
            at = named(h, base, width)
            own = K.inside(doc, width)[: len(at)]
            if width == 2 * base:
                own &= hit[at]
            else:
                own &= hit[: len(at)] & hit[width // 2 : width // 2 + len(at)]
            w = np.flatnonzero(own)
            if len(w):
                g = K.gram_hashes(h, width)[w]
                yield from send.add(bucket_of(K.gram_hashes(h, base)[at[w]], buckets), g, ids[doc[w]], w - first[doc[w]])
        yield from send.rest()

    return run


def _kept(width: int, keep_text: bool, also: list[str]):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch, buf, offs in text_chunks(batches):
            data, n, gone, sha, texts = buf.tobytes(), [], [], [], []
            for a, b, at in zip(offs[:-1].tolist(), offs[1:].tolist(), _flat(batch), strict=True):
                words = data[a:b].split()
                n.append(len(words))
                if len(at):
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    words = list(compress(words, stay.tolist()))
                gone.append(n[-1] - len(words))
                line = b" ".join(words)
                sha.append(hashlib.sha256(line).hexdigest())
                if keep_text:
                    texts.append((line if gone[-1] else data[a:b]).decode())
            cols = {"id": batch.column("id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"kept_text": pa.array(texts, pa.string())} if keep_text else {}) | {c: batch.column(c) for c in also})

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 20, base: int = 10, keep_text: bool = False, also: tuple[Column, ...] = ()) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) of every row of docs.

    A word goes if a window of `words` words covers it whose word sequence also starts earlier (smaller id, or
    same id and earlier start) in docs. words is base times a power of two, 2 at least. kept_text has the kept
    words joined by spaces where any was removed, else the text as it is. A null or empty text has no
    words and loses none. Rows that repeat an id count as that one document, and a document isn't its own earlier
    copy. Rows with a null id come back unchanged. also: further columns to return;
    all others are ignored, whatever their names. An empty table gives no rows. Exact but
    for 64-bit hashes.
    """
    steps = words // base
    if steps < 2 or base * steps != words or steps & (steps - 1):
        raise ValueError("words must be base times 2, 4, 8, ...")
    spark = docs.sparkSession
    small_batches(spark)
    buckets = bucket_count(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *also)
    more = src.schema[2:]
    entry = "bucket int, " + ", ".join(f"{n} binary" for n in _ENTRY)

    def settled(entries: DataFrame, first: bool) -> DataFrame:
        found = entries.groupBy("bucket").applyInArrow(_repeats(first), "id long, at binary")
        return found.groupBy("id").agg(F.collect_list("at").alias("at"))

    some = src.select("id", "text").where("id is not null")
    at = settled(some.mapInArrow(_base_level(base, buckets), entry), False)
    width = 2 * base
    while True:
        last = width == words
        at = settled(some.join(dealt(at), "id").mapInArrow(_next_level(base, width, last, buckets), entry), last)
        if last:
            break
        width *= 2
    out = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    out += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in more)
    names = [f.name for f in more]
    return src.join(dealt(at), "id", "left").select("id", "text", "at", *names).mapInArrow(_kept(words, keep_text, names), out)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
