"""Token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

Pre-tokens are what lies between spaces: no piece of the vocabulary has a word separator after another letter, so
no merge crosses one (checked when the model is loaded). The first tier is a broadcast table with the lengths of
frequent pre-tokens, found in a bounded sample; it only saves work and never changes a count. Misses are encoded by the
library through a worker's bounded cache, cut at line feeds where no piece has one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, text_chunks
from .wordcache import Cache

#: Documents sampled for the frequent table, tasks that count their words, entries, and those that a worker adds.
SAMPLE, TASKS, FREQUENT, WORDS = 2_000, 4, 65_536, 300_000
_MARK = "▁"


@lru_cache(2)
def _model(path: str):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    apart = not any(_MARK in p.lstrip(_MARK) for p in pieces)
    lines = not any("\n" in p for p in pieces)
    return sp, apart, lines


@lru_cache(2)
def _caches(path: str) -> Cache:
    sp, _, lines = _model(path)
    whole = Cache(lambda w: len(sp.encode(w.decode())), WORDS)
    after = Cache(lambda w: len(sp.encode("\n" + w.decode())) - 2, WORDS)  # without the separator and the line feed

    def count(w: bytes) -> int:
        if not w:
            return 1
        if lines and b"\n" in w:
            first, *rest = w.split(b"\n")
            return (whole[first] if first else 1) + sum([1 + (after[x] if x else 0) for x in rest])
        return whole[w]

    return Cache(count, WORDS + FREQUENT)


def _plain(text: bytes) -> bool:
    return not (text.startswith(b" ") or text.endswith(b" ") or b"  " in text or b"\xe2\x96\x81" in text)


def _count(path: str, limit: int, shared):
    def run(batches: Iterator[pa.RecordBatch]):
        sp, apart, _ = _model(path)
        words = _caches(path)
        if not words.get("seeded"):
            words.update(shared.value)
            words["seeded"] = 1
        for batch, buf, offs in text_chunks(batches):
            data, n, size = buf.tobytes(), [], (offs[1:] - offs[:-1])
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                text = data[a:b]
                if not text:
                    n.append(0)
                elif apart and _plain(text):
                    n.append(sum(map(words.__getitem__, text.split(b" "))))
                else:
                    n.append(len(sp.encode(text.decode())))
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), n, pc.greater(n, limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return run


def _frequent(batches: Iterator[pa.RecordBatch]):
    seen: Counter = Counter()
    for _, buf, offs in text_chunks(batches):
        data = buf.tobytes()
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            seen.update(data[a:b].split(b" "))
        if len(seen) > 8 * FREQUENT:
            seen = Counter(dict(seen.most_common(4 * FREQUENT)))
    top = seen.most_common(FREQUENT)
    yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, sample: int = SAMPLE) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: tokens of the whole text, without begin or end tokens.

    path: a sentencepiece model that every executor can open. A null or empty text has no tokens. Texts with double
    spaces, spaces at an end or a literal separator go to the library whole. Other columns are ignored; repeated
    rows give repeated results; a null id stays null; an empty table gives no rows. sample: documents (about) that fill the first tier.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.count()
    some = src.sample(min(1.0, sample / rows), 7) if rows else src
    found: Counter = Counter()  # the sampled texts meet in a few tasks, each of which returns FREQUENT words at most
    for r in some.select("text").repartition(TASKS).mapInArrow(_frequent, "word binary, n long").collect():
        found[bytes(r.word)] += r.n
    words, top = _caches(path), sorted(found.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]
    table = {w: words[w] for w, n in top if n > 2 and len(w) <= 256}
    return src.mapInArrow(_count(path, limit, spark.sparkContext.broadcast(table)), "id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
