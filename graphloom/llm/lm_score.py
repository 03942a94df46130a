"""Masked pseudo-likelihood scores: a bidirectional window network predicts every token from both sides.

The vocabulary has the corpus's most frequent words by counts over all documents, and one class for the rest, whose
words share its probability by their counts; these stay in the executors, where each bucket of words has all their
occurrences. For a token, the words up to SPAN before and after it add up, each
place with a table of its own; a ReLU layer follows, and two softmax layers give the token's group and then the
token in its group. The network is trained in numpy: in each round every task runs over a share of its windows,
starting from the same weights, and the tasks' weights are averaged in the shuffle. A document's score is the sum of
the log-probabilities of its tokens, each given its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .buckets import Packer, bucket_count, bucket_of, unpack
from .shared import dealt, partitions, small_batches, text_chunks

#: Groups, words in a group, hidden units, words on either side.
GROUPS, MEMBERS, HIDDEN, SPAN = 48, 48, 24, 2
#: Windows of a task's first training steps and of its largest; a step has up to an eighth of what came before.
STEP, STEPS = 1024, 8192
#: Step width of training: each weight's gradient is divided by the root of the sum of its squares (Adagrad).
RATE = 0.05
#: A round trains on one window in EVERY (which ones, a hash of document and place says); EVERY rounds cover all.
EVERY = ROUNDS = 2
SIZE = GROUPS * MEMBERS
#: Word ids: 0 the rest, 1 to SIZE - 1 known words, SIZE beyond either end of a text.
REST, EDGE = 0, SIZE


@dataclass(frozen=True)
class Vocabulary:
    """Hashes of known words, sorted, their ids, the count of each id, and the log-count of all words not known."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    rest: float

    def lookup(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], REST)


def shapes() -> list[tuple[int, ...]]:
    return [(2 * SPAN, SIZE + 1, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, MEMBERS), (GROUPS, MEMBERS)]


def unflatten(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes():
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def initial(vocab: Vocabulary, seed: int = 3) -> np.ndarray:
    """Small random weights, and biases that give each word its share of the corpus whatever its neighbours."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s) for s in shapes()]
    n = (vocab.counts + 1.0).reshape(MEMBERS, GROUPS).T  # id = member * GROUPS + group
    w[2] *= 0.1
    w[4] *= 0.1
    w[3], w[5] = np.log(n.sum(1)), np.log(n)
    return np.concatenate([x.ravel() for x in w]).astype(np.float32)


def contexts(t: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ids of the words around each place in at, EDGE beyond the document."""
    out = np.full((2 * SPAN, len(at)), EDGE)
    for k, d in enumerate([*range(-SPAN, 0), *range(1, SPAN + 1)]):
        j = at + d
        ok = (j >= 0) & (j < len(t))
        ok[ok] = doc[j[ok]] == doc[at[ok]]
        out[k, ok] = t[j[ok]]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place; log-weights are kept within what float32 can hold."""
    np.exp(np.clip(z, -60, 60, out=z), out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _log_pick(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Of each row of log-weights the log-probability of its kth."""
    np.clip(z, -60, 60, out=z)
    own = z[np.arange(len(k)), k]
    return own - np.log(np.exp(z, out=z).sum(1))


def hidden(w: list[np.ndarray], c: np.ndarray) -> np.ndarray:
    z = w[0][0][c[0]]
    z += w[1]
    for k in range(1, len(c)):
        z += w[0][k][c[k]]
    return np.maximum(z, 0, out=z)


def _by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of group, and where each group begins; small integers are sorted by counting."""
    order = np.argsort(group.astype(np.int16), kind="stable")
    return order, np.searchsorted(group[order], np.arange(GROUPS + 1))


def log_probs(w: list[np.ndarray], c: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log p of each token y given its context."""
    order, cuts = _by_group(y % GROUPS)
    x = hidden(w, c[:, order])
    group, member = y[order] % GROUPS, y[order] // GROUPS
    got = _log_pick(x @ w[2] + w[3], group)
    for g in np.flatnonzero(np.diff(cuts)):
        rows = slice(cuts[g], cuts[g + 1])
        got[rows] += _log_pick(x[rows] @ w[4][g] + w[5][g], member[rows])
    out = np.empty_like(got)
    out[order] = got
    return out


def train_step(w: list[np.ndarray], seen: list[np.ndarray], c: np.ndarray, y: np.ndarray, rate: float = RATE) -> None:
    """One step of gradient ascent on a batch's mean log-likelihood, in place; seen: sums of squared gradients.

    Of the words' tables only the rows that the batch has are touched; the others have no gradient.
    """
    order, cuts = _by_group(y % GROUPS)
    c, y = c[:, order], y[order]
    x = hidden(w, c)
    n = len(y)
    group, member = y % GROUPS, y // GROUPS
    grad = [None, *[np.zeros_like(p) for p in w[1:]]]
    d = _softmax(x @ w[2] + w[3])  # what to take away: probabilities, less 1 for the token itself
    d[np.arange(n), group] -= 1
    back = d @ w[2].T
    grad[2], grad[3] = x.T @ d, d.sum(0)
    for g in np.flatnonzero(np.diff(cuts)):
        rows = slice(cuts[g], cuts[g + 1])
        e = _softmax(x[rows] @ w[4][g] + w[5][g])
        e[np.arange(len(e)), member[rows]] -= 1
        back[rows] += e @ w[4][g].T
        grad[4][g], grad[5][g] = x[rows].T @ e, e.sum(0)
    back *= x > 0
    back /= n
    grad[1] = back.sum(0) * n
    for k in range(len(c)):
        at = np.argsort(c[k].astype(np.int16), kind="stable")
        ids = c[k][at]
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rows, g = ids[cuts], np.add.reduceat(back[at], cuts, axis=0)
        seen[0][k][rows] += g * g
        w[0][k][rows] -= rate * g / (np.sqrt(seen[0][k][rows]) + 1e-6)
    for p, g, q in zip(w[1:], grad[1:], seen[1:], strict=True):
        g /= n
        q += g * g
        p -= rate * g / (np.sqrt(q) + 1e-6)


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e, doc = K.words(buf, offs)
    return K.span_hashes(buf, s, e, True), doc, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offs) - 1))])


def _counts(batches: Iterator[pa.RecordBatch]):
    """(word, n) of a task's words; very many different ones are sent in parts."""
    held: list[np.ndarray] = []
    size = 0

    def send():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    for _, buf, offs in text_chunks(batches):
        held.append(_words(buf, offs)[0])
        size += len(held[-1])
        if size > 1 << 22:
            yield send()
            held, size = [], 0
    if held:
        yield send()


def vocabulary(src: DataFrame) -> Vocabulary:
    """The SIZE - 1 most frequent words by counts over all texts; ties by hash."""
    counts = src.select("text").mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(SIZE - 1)
    known = top.collect()  # SIZE rows at most
    total = counts.agg(F.sum("n")).first()[0] if len(known) == SIZE - 1 else None
    rest = (total or 0) - sum(r.n for r in known) if total else 0
    h = np.array([r.word for r in known], np.int64).view(np.uint64)
    order = np.argsort(h)
    counts = np.zeros(SIZE, np.int64)
    counts[0], counts[1 : len(known) + 1] = rest, [r.n for r in known]
    return Vocabulary(h[order], (order + 1).astype(np.int64), counts, float(np.log(max(rest, 1))))


def _train(shared, every: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]):
        vocab, flat = shared.value
        flat = flat.copy()
        w, done = unflatten(flat), 0
        seen = [np.zeros_like(p) for p in w]
        rest: list[tuple[np.ndarray, np.ndarray]] = []
        for batch, buf, offs in text_chunks(batches):
            h, doc, first = _words(buf, offs)
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.uint64)
            place = (np.arange(len(h)) - first[doc]).astype(np.uint64)
            at = np.flatnonzero(K.mix(ids[doc] * np.uint64(1 << 20) + place) % np.uint64(every) == turn % every)
            if not len(at):
                continue
            t = vocab.lookup(h)
            c, y = contexts(t, doc, at), t[at]
            if rest:
                c, y = np.concatenate([rest[0][0], c], 1), np.concatenate([rest[0][1], y])
            order = np.argsort(K.mix(np.arange(len(y), dtype=np.uint64)))
            c, y = c[:, order], y[order]
            k, step = 0, min(STEPS, max(STEP, done // 8))
            while len(y) - k >= step:
                train_step(w, seen, c[:, k : k + step], y[k : k + step])
                done, k = done + step, k + step
                step = min(STEPS, max(STEP, done // 8))
            rest = [(c[:, k:], y[k:])]
        if rest and len(rest[0][1]):
            train_step(w, seen, *rest[0])
            done += len(rest[0][1])
        if done:
            cut = np.array_split(flat, 64)
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([float(done)] * 64), pa.array([x.tobytes() for x in cut], pa.binary())], names=["part", "weight", "w"])

    return run


def _average(table: pa.Table) -> pa.Table:
    total, weight = None, 0.0
    for n, x in zip(table.column("weight").to_pylist(), table.column("w"), strict=True):
        x = np.frombuffer(x.as_buffer(), np.float32) * n
        total, weight = (x if total is None else total + x), weight + n
    return pa.table({"part": table.column("part")[:1], "w": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})


def fit(src: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, every: int = EVERY) -> np.ndarray:
    """Weights after `rounds` rounds over (id, text); each takes another share of the windows of all texts, and `every` rounds take all."""
    sc, flat = src.sparkSession.sparkContext, initial(vocab)
    for turn in range(rounds):
        parts = src.mapInArrow(_train(sc.broadcast((vocab, flat)), every, turn), "part int, weight double, w binary")
        rows = parts.groupBy("part").applyInArrow(_average, "part int, w binary").collect()  # the size of the network
        if not rows:
            return flat
        flat = np.concatenate([np.frombuffer(r.w, np.float32) for r in sorted(rows, key=lambda r: r.part)])
    return flat


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        vocab, flat = shared.value
        w = unflatten(flat)
        for batch, buf, offs in text_chunks(batches, limit=1 << 19):
            h, doc, first = _words(buf, offs)
            t, total = vocab.lookup(h), np.zeros(batch.num_rows)
            for a in range(0, len(t), 1 << 14):
                at = np.arange(a, min(a + (1 << 14), len(t)))
                p = log_probs(w, contexts(t, doc, at), t[at]).astype(np.float64)
                total += np.bincount(doc[at], weights=p - vocab.rest * (t[at] == REST), minlength=batch.num_rows)
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(total)], names=["id", "key", "n_tokens", "log_prob"])

    return run


def _rest_words(shared, buckets: int):
    """Each text's words outside the vocabulary: word, the text's key, how often, and how often for the counts."""

    def run(batches: Iterator[pa.RecordBatch]):
        known, pack = shared.value[0], Packer(buckets, ["words", "keys", "n", "counted"])
        for batch, buf, offs in text_chunks(batches):
            h, doc, _ = _words(buf, offs)
            out = known.lookup(h) == REST
            h, doc = h[out], doc[out]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            cuts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(cuts, len(h))).astype(np.uint32)
            h, doc = h[cuts], doc[cuts]
            key = batch.column("key").to_numpy(zero_copy_only=False)[doc]
            null = batch.column("id").is_null().to_numpy(zero_copy_only=False)[doc]
            yield from pack.add(bucket_of(h, buckets), h, key, n, np.where(null, 0, n).astype(np.uint32))
        yield from pack.rest()

    return run


def _log_counts(buckets: int):
    """Of a bucket of words, for each text the sum of the logs of its words' counts in the corpus, packed by bucket of text."""

    def run(table: pa.Table) -> pa.Table:
        word, key = unpack(table, "words", np.uint64), unpack(table, "keys", np.int64)
        n, counted = unpack(table, "n", np.uint32), unpack(table, "counted", np.uint32)
        _, which = np.unique(word, return_inverse=True)
        total = np.maximum(np.bincount(which, weights=counted), 1)
        keys, text = np.unique(key, return_inverse=True)
        extra = np.bincount(text, weights=n * np.log(total)[which], minlength=len(keys))
        pack = Packer(buckets, ["keys", "extra"])
        return pa.Table.from_batches([*pack.add(bucket_of(K.mix(keys.view(np.uint64)), buckets), keys, extra), *pack.rest()], _SENT)

    return run


_SENT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])


def _sums(table: pa.Table) -> pa.Table:
    """(key, extra) of a bucket of texts."""
    keys, text = np.unique(unpack(table, "keys", np.int64), return_inverse=True)
    return pa.table({"key": pa.array(keys), "extra": pa.array(np.bincount(text, weights=unpack(table, "extra", np.float64), minlength=len(keys)))})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, every: int = EVERY) -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob) of every row: the natural log of its masked pseudo-likelihood.

    Tokens are words, A-Z as a-z. The vocabulary and the network come from docs itself. A word outside the vocabulary
    has the probability of that class times its share of all such words' count in docs. A null or empty text has 0 tokens, log_prob 0
    and a null mean. Repeated rows get equal scores; rows with a null id are scored but not trained on; other columns
    are ignored; an empty table gives no rows.

    Counts read all documents, and training every window of them once where rounds = every; the driver receives the vocabulary and one set of weights for each round,
    averaged in the shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("key", F.xxhash64("text"))
    some = src.where("id is not null")
    vocab = vocabulary(some)
    flat = fit(some, vocab, rounds, every)
    shared, buckets = spark.sparkContext.broadcast((vocab, flat)), bucket_count(spark)
    rest = src.mapInArrow(_rest_words(shared, buckets), "bucket int, words binary, keys binary, n binary, counted binary")
    sent = rest.groupBy("bucket").applyInArrow(_log_counts(partitions(spark)), "bucket int, keys binary, extra binary")
    extra = sent.groupBy("bucket").applyInArrow(_sums, "key long, extra double")
    # Rows of equal text have one key, and its sum is over all of them.
    extra = extra.join(dealt(src.groupBy("key").agg(F.count("*").alias("rows"))), "key").select("key", (F.col("extra") / F.col("rows")).alias("extra"))
    out = src.mapInArrow(_score(shared), "id long, key long, n_tokens long, log_prob double").join(dealt(extra), "key", "left")
    out = out.select("id", "n_tokens", (F.col("log_prob") + F.coalesce("extra", F.lit(0.0))).alias("log_prob"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
