"""BPE encoding and decoding of a text column by the token automaton of bpe.py."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import automaton
from .shared import small_batches, text_chunks
from .wordcache import Cache

#: Words and pre-split words that a worker keeps; longer ones than wordcache.LONGEST are never kept.
WORDS, PARTS = 400_000, 400_000


@lru_cache(2)
def _words(path: str) -> Cache:
    """A word's ids as decimals, joined by spaces."""
    a = automaton(path)
    text = {i: b"%d" % i for i in a.labels}
    parts = Cache(lambda w: b" ".join([text[i] for i in a.encode_word(w)]), PARTS)

    # White space never joins two words, so a text's ids are those of its words.
    def encode(word: bytes) -> bytes:
        return b" ".join([text[w] if isinstance(w, int) else parts[w] for w in a.split(word.decode())])

    return Cache(encode, WORDS)


@lru_cache(2)
def _labels(path: str) -> dict[bytes, bytes]:
    """The arc label of each id in decimals."""
    return {b"%d" % i: label.encode() for i, label in automaton(path).labels.items()}


def _run(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        known, labels = _words(path), _labels(path)
        for batch, buf, offs in text_chunks(batches):
            data, n, sha, back, lists = buf.tobytes(), [], [], [], []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                line = b" ".join([p for p in map(known.__getitem__, data[a:b].split()) if p])
                ids = line.split()
                n.append(len(ids))
                sha.append(hashlib.sha256(line).hexdigest())
                back.append(hashlib.sha256(b" ".join(map(labels.__getitem__, ids))).hexdigest())
                if keep_ids:
                    lists.append([int(i) for i in ids])
            cols = {"id": batch.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(lists, pa.list_(pa.int32()))} if keep_ids else {}))

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row, in one pass without a shuffle.

    path: a BPE vocabulary file that every executor can open. A null or empty text has no tokens, and the digests of
    the empty string. Texts are encoded whole, and decoded_sha256 is of what the ids decode to; repeated rows give
    repeated results; a null id stays null; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_run(path, keep_ids), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """tokens with a column decoded: the arc labels of each list of ids, joined by spaces (null for a null list).

    Ids that the vocabulary lacks emit nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        labels = automaton(path).labels
        for batch in batches:
            out = [None if x is None else " ".join(labels[i] for i in x if i in labels) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{kinds}, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return out.withColumnRenamed("id", "doc_id")
