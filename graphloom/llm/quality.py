"""Quality rules: Viterbi decoding of a linear-chain conditional random field marks lines as content or boilerplate.

Per line the field sees shares of capitals, symbols, exclamation marks and of words that repeat the word before. Its weights are fitted on a bounded sample of labelled documents: a first pass
tells which lines of rejected documents look like those of good ones, a second fits the field on lines so marked. A
document stays if enough of its words are in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import lists, small_batches, text_chunks

#: Fixed values of the base rules: symbol characters, words of a window, least words, most repeated words in percent.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30
#: Labelled documents of each class that the fit may use, its steps, the most lines of one sequence of the fit, and the share of content words that stays.
SAMPLE, STEPS, STRETCH, SHARE = 500, 250, 48, 0.5
FEATURES = ("bias", "capitals", "symbols", "exclamations", "same_word")


@dataclass(frozen=True)
class Field:
    """Weights of the content label for each feature, and of each pair of neighbouring labels (boilerplate 0, content 1)."""

    emit: tuple[float, ...]
    step: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, scores: list[float]) -> list[int]:
        """The best label sequence for the lines' content scores; content wins ties."""
        (a, b), (c, d) = self.step
        low, high, back = 0.0, scores[0], []
        for s in scores[1:]:
            p, q, r, t = low + a, high + c, low + b, high + d
            back.append((q >= p, t >= r))
            low, high = (q if q >= p else p), s + (t if t >= r else r)
        y = high >= low
        out = [int(y)]
        for to_low, to_high in reversed(back):
            y = to_high if y else to_low
            out.append(int(y))
        return out[::-1]


#: Without labels: every line is content, so only the base rules reject.
ALL_CONTENT = Field((1.0,) + (0.0,) * (len(FEATURES) - 1), ((0.0, 0.0), (0.0, 0.0)))


def _table(chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) if isinstance(c, str) else c for c in chars]] = True
    return out


_SYMBOL, _UPPER, _LETTER, _BANG, _LEAD = _table(SYMBOLS), _table(range(65, 91)), _table([*range(65, 91), *range(97, 123)]), _table("!"), _table([*range(128), *range(192, 256)])


def _repeated(h: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in windows of k words that their document has twice or more."""
    g = K.gram_hashes(h, k)
    own = np.flatnonzero(K.inside(doc, k))
    key = g[own] ^ K.mix(doc[own].astype(np.uint64))
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    many = np.zeros(len(s), bool)
    many[1:] |= same
    many[:-1] |= same
    at = own[order[many]]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.cumsum(edge)[:-1] > 0


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each document, and for each line with a word its document, words and features."""
    n = len(offs) - 1
    s, e, doc = K.words(buf, offs)
    h = K.span_hashes(buf, s, e)
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    per_doc = lambda sums: sums[offs[1:]] - sums[offs[:-1]]
    symbols, upper, letters, bangs = (total(t[buf]) for t in (_SYMBOL, _UPPER, _LETTER, _BANG))
    rep = _repeated(h, doc, WINDOW)
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": per_doc(total(_LEAD[buf] & ~K._SPACE[buf])), "n_symbols": per_doc(symbols), "n_repeat_words": np.bincount(doc[rep], minlength=n)}
    breaks = np.flatnonzero(buf == 10)
    place = np.searchsorted(breaks, s) + doc
    new = np.concatenate([[True], place[1:] != place[:-1]]) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    line = np.cumsum(new) - 1
    line_doc, k = doc[first], place[first] - doc[first]
    start = np.maximum(offs[line_doc], np.concatenate([[-1], breaks])[k] + 1)
    stop = np.minimum(offs[line_doc + 1], np.append(breaks, len(buf))[k])
    key = K.span_hashes(buf, start, stop) ^ K.mix(line_doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(first), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    words = np.bincount(line, minlength=len(first)).astype(np.float64)
    span = lambda sums: (sums[stop] - sums[start]).astype(np.float64)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]) if len(h) else np.zeros(0, bool)
    share = lambda mask: np.bincount(line[mask], minlength=len(first)) / np.maximum(words, 1)
    x = [np.ones(len(first)), span(upper) / np.maximum(span(letters), 1), np.minimum(3 * span(symbols) / np.maximum(words, 1), 1), np.minimum(3 * span(bangs) / np.maximum(words, 1), 1)]
    x.append(np.minimum(3 * share(same), 1))
    return out | {"line_doc": line_doc, "line_words": words.astype(np.int64), "features": np.stack(x, 1)}


def _samples(batches: Iterator[pa.RecordBatch]):
    for batch, buf, offs in text_chunks(batches):
        m = measure(buf, offs)
        per = np.bincount(m["line_doc"], minlength=batch.num_rows)
        yield pa.RecordBatch.from_pydict({"good": batch.column("good"), "x": lists(m["features"].astype(np.float32).ravel(), per * len(FEATURES), pa.float32())})


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Climb from 0 along gradient(weights)."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def line_labels(x: np.ndarray, good: np.ndarray, steps: int = 400) -> np.ndarray:
    """1 for lines that a logistic fit of their documents' labels takes for content, and for all lines of good ones."""
    weight = np.where(good == 1, 0.5 / max(1, (good == 1).sum()), 0.5 / max(1, (good == 0).sum()))
    w = _adam(lambda w: ((good - 1 / (1 + np.exp(-(x @ w)))) * weight) @ x - 1e-5 * w, x.shape[1], steps, 0.1)
    return np.where((good == 1) | (x @ w > 0), 1, 0)


def train(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = STEPS, rate: float = 0.1, decay: float = 1e-5) -> Field:
    """Fit by gradient ascent on the conditional log-likelihood of each sequence's line labels."""
    keep = [i for i, s in enumerate(sequences) if len(s)]
    if not keep or len({v for i in keep for v in labels[i].tolist()}) < 2:
        return ALL_CONTENT
    n, most = len(keep), max(len(sequences[i]) for i in keep)
    x, real, y = np.zeros((n, most, len(FEATURES))), np.zeros((n, most), bool), np.zeros((n, most), np.int64)
    for row, i in enumerate(keep):
        x[row, : len(sequences[i])] = sequences[i]
        y[row, : len(sequences[i])] = labels[i]
        real[row, : len(sequences[i])] = True
    pairs = real[:, 1:] & real[:, :-1]
    seen = np.array([[(pairs & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    scale = 1 / real.sum()

    def gradient(v: np.ndarray) -> np.ndarray:
        w, step = v[:-4], v[-4:].reshape(2, 2)
        emit = np.stack([np.zeros((n, most)), x @ w], 2)
        f, b = emit.copy(), np.zeros((n, most, 2))
        for j in range(1, most):
            f[:, j] = np.where(pairs[:, j - 1, None], np.logaddexp.reduce(f[:, j - 1, :, None] + step, axis=1) + emit[:, j], f[:, j - 1])
        for j in range(most - 2, -1, -1):
            b[:, j] = np.where(pairs[:, j, None], np.logaddexp.reduce(step + (emit[:, j + 1] + b[:, j + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(f[:, -1], axis=1)[:, None]
        p = np.exp(np.minimum(f[:, :, 1] + b[:, :, 1] - z, 0))
        joint = np.exp(np.minimum(f[:, :-1, :, None] + step + (emit[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, :, None, None], 0))
        g = np.concatenate([np.einsum("nl,nlf->f", np.where(real, y - p, 0), x), (seen - (joint * pairs[:, :, None, None]).sum((0, 1))).ravel()])
        return g * scale - decay * v

    v = _adam(gradient, len(FEATURES) + 4, steps, rate)
    return Field(tuple(v[:-4].tolist()), tuple(map(tuple, v[-4:].reshape(2, 2).tolist())))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted on at most `sample` labelled documents of each class (labels: doc_id, quality 0/1).

    Which ones follows from a hash of the id; `sample` is the only bound, and all lines of the sampled documents count.
    Labels that are null, or without a document, are ignored; without both classes, or with empty tables, every line
    counts as content. A null text has no lines. Rows that repeat an id, or a label, count as often as they occur.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("good"))
    pick = lambda q: known.where(F.col("good") == q).orderBy(F.xxhash64("id"), "id").limit(sample)
    some = F.broadcast(pick(0).unionByName(pick(1)))  # 2 * sample rows of two numbers
    src = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(some, "id")
    rows = src.select("good", "text").mapInArrow(_samples, "good int, x array<float>").collect()
    sequences = [np.array(r.x, np.float64).reshape(-1, len(FEATURES)) for r in rows]
    # Long documents are several sequences, which keeps the fit's padded arrays small; decoding always takes whole documents.
    parts = [(int(r.good), s[a : a + STRETCH]) for r, s in zip(rows, sequences, strict=True) for a in range(0, len(s), STRETCH)]
    sequences = [s for _, s in parts]
    sizes = [len(s) for s in sequences]
    if not sum(sizes):
        return ALL_CONTENT
    marks = line_labels(np.concatenate(sequences), np.repeat([good for good, _ in parts], sizes))
    return train(sequences, np.split(marks, np.cumsum(sizes)[:-1]))


def _judge(field: Field, share: float, marks: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        emit = np.array(field.emit)
        for batch, buf, offs in text_chunks(batches):
            m = measure(buf, offs)
            score, words, per = (m["features"] @ emit).tolist(), m["line_words"], np.bincount(m["line_doc"], minlength=batch.num_rows)
            y = np.zeros(len(score), np.int64)
            at = 0
            for c in per.tolist():
                if c:
                    y[at : at + c] = field.decode(score[at : at + c])
                at += c
            content = np.bincount(m["line_doc"], weights=y * words, minlength=batch.num_rows).astype(np.int64)
            failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
            kept = ~failed & (content >= share * m["n_words"])
            cols = {"id": batch.column("id")} | {k: pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            cols |= {"base_failed": pa.array(failed), "kept": pa.array(kept), "content_words": pa.array(content, pa.int64())}
            yield pa.RecordBatch.from_pydict(cols | ({"line_labels": lists(y, per, pa.int32())} if marks else {}))

    return run


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, marks: bool = False) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words[, line_labels]).

    One row for each row of docs, in one pass without a shuffle. A document is kept if it passes the base rules and at
    least `share` of its words are in lines marked content. line_labels: 1 or 0 for each line with a word. A null or
    empty text has no words and fails. Repeated rows are judged alike; other columns are ignored; an empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long"
    return src.mapInArrow(_judge(field, share, marks), kinds + ", line_labels array<int>" * marks)


def keep_content(docs: DataFrame, field: Field, text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of docs that judge() would keep, with all their columns, in one pass without a shuffle.

    A null or empty text has no words and goes. Rows with a null id are judged like others, repeated rows alike;
    further columns stay as they are, whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        decide = _judge(field, share, False)
        for batch in batches:
            text = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], names=["id", "text"])
            kept = [x.column("kept") for x in decide(iter([text]))]
            yield batch.filter(pa.chunked_array(kept, pa.bool_()).combine_chunks()) if kept else batch

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, fit(docs, labels)).withColumnRenamed("id", "doc_id")
