"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1. Documents with equal n-gram sets fall into one class (a hash of the whole set); one representative goes on.
2. Two sets that reach the threshold t differ in at most D = (a + b) * (1 - t) / (1 + t) n-grams. Each set is dealt
   by hash into D + 1 parts and some more, so two such sets agree in more parts than one. The key of a part is a hash
   of what it holds; a set sends keys of its parts that hold something. A set with so many empty parts that all parts
   in which it agrees with another might be empty (see Bound.parts) sends keys of the empty ones too, so that no link
   is lost, and unrelated sets don't meet in an empty part. N-grams that a great many documents have are left out of
   the parts, unless they are nearly all that a set has: a passage that a third of the documents share brings nothing
   together.
3. Of the documents with one key the plainest (fewest rare n-grams) is the pivot; each document is paired with the
   plainest pivot that it meets. Pairs whose sizes and parities allow a link are verified by a masked product: incidence rows of a task's pairs, a block of
   columns at a time, add up overlap counts, and a pair goes when its count and what is left can't reach its
   size-derived bound. Only links that pass tie documents together.
4. Where a key's documents still belong to different components, they are paired with the pivot of another one and
   verified likewise; in keys that remain in several, every pair of different components is compared, first by
   parities (which bound the difference from below), then by the product. A pair with many such keys comes from the
   first one alone.
5. Components of the links give the classes' component ids, and membership the documents'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .buckets import FLUSH, Packer, bucket_count, bucket_of, unpack
from .components import components
from .shared import dealt, discard, materialize, small_batches, text_chunks, texts_of

#: Documents with one key in a flush that meet on the map side; rows in a block of pairs; column blocks of the product.
LOCAL, BLOCK, COLUMNS = 16, 1024, 8
#: Documents of a key up to which keys are taken together, so many pairs at a time.
TOGETHER, PAIRS = 64, 1 << 17
#: An n-gram is frequent that one document in so many has; the table of them has at most so many entries.
ONE_IN, FREQUENT = 512, 1 << 17
#: Salts of exact copies' classes, most bits of the filter of keys with several components and bits for each key, 64-bit words of parities; first keys of a document that its rows hold, and what stands for none.
SALTS, FILTER, KEY_BITS, PARITY, FIRST, NONE = 16, 1 << 28, 16, 16, 16, np.uint64((1 << 64) - 1)


class Bound:
    """The threshold p/q as integer tests."""

    def __init__(self, p: int, q: int):
        if not 0 < p <= q:
            raise ValueError("the threshold must be over 0 and at most 1")
        self.p, self.q = p, q

    def differ(self, total):
        """The most n-grams in which two sets with so many elements together may differ."""
        return total * (self.q - self.p) // (self.p + self.q)

    def overlap(self, total):
        """The least overlap of two sets with so many elements together."""
        return -(-self.p * total // (self.p + self.q))

    def classes(self, most: int) -> np.ndarray:
        """Upper ends of the size classes: a set and a smaller partner are in the same or neighbouring classes; one class is above most."""
        ends = [0, 1]
        while ends[-2] < most:
            ends.append(max(ends[-1] + 1, -(-ends[-1] * self.q // self.p)))
        return np.array(ends)

    def parts(self, ends: np.ndarray) -> np.ndarray:
        """Parts of each size class: one more than may differ, and as many more as are seldom all empty.

        Two sets that link agree in at least parts - differ of them. If one of these holds something, they share its
        key; if none does, both have that many empty parts.
        """
        out = []
        for low, high in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            least = n = self.differ(2 * high) + 1
            for _ in range(20):
                mean = n * np.exp(-(low + 1) / n)
                more = min(2 * least, least + int(np.ceil(mean + 4 * np.sqrt(mean))))
                if more == n:
                    break
                n = more
            out.append(n)
        return np.array(out)


class Classes:
    """The size classes as far as they were needed, with their parts."""

    def __init__(self, bound: Bound):
        self.bound = bound
        self.grow(1 << 12)

    def grow(self, most: int) -> None:
        self.ends = self.bound.classes(most)
        self.most = self.bound.differ(2 * self.ends)
        self.parts = self.bound.parts(self.ends)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """Each set's class c: ends[c - 1] < size <= ends[c]."""
        if len(sizes) and sizes.max() > self.ends[-2]:
            self.grow(int(sizes.max()) * 2)
        return np.searchsorted(self.ends, sizes)


def _sets(batch, buf, offs, n: int, lower: bool):
    """Flat sorted n-gram sets of a chunk, sizes, and two sums that name a set."""
    s, e, d = K.words(buf, offs)
    flat, sizes = K.shingle_sets(K.span_hashes(buf, s, e, lower), d, batch.num_rows, n)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(flat ^ np.uint64(k)), dtype=np.uint64)]) for k in (11, 23)]
    return flat, sizes, [x[ends[1:]] - x[ends[:-1]] for x in sums]


def _sketch(n: int, lower: bool):
    """(id, n, s1, s2) of each document; with a null id, (n-gram, count) of what is frequent in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, buf, offs in text_chunks(batches):
            flat, sizes, sums = _sets(batch, buf, offs, n, lower)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *(pa.array(x.view(np.int64)) for x in sums)], names=["id", "n", "s1", "s2"])
            grams, count = np.unique(flat, return_counts=True)
            often = count >= max(4, batch.num_rows * 2 // ONE_IN)
            if often.any():
                k = int(often.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(np.full(k, -1)), pa.array(grams[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=["id", "n", "s1", "s2"])

    return run


def _dealt(h: np.ndarray, row: np.ndarray, parts: np.ndarray):
    """Sums of what falls into each part of each row, how many fall there, and the row and number of a part."""
    first = np.concatenate([[0], np.cumsum(parts)])
    slot = first[row] + ((h >> np.uint64(20)) % parts[row].astype(np.uint64)).astype(np.int64)
    total = np.zeros(first[-1], np.uint64)
    np.add.at(total, slot, K.mix(h ^ np.uint64(77)))
    owner = np.repeat(np.arange(len(parts)), parts)
    return total, np.bincount(slot, minlength=first[-1]), owner, (np.arange(first[-1]) - first[owner]).astype(np.uint64)


def _part_keys(flat: np.ndarray, sizes: np.ndarray, classes: Classes, frequent: np.ndarray):
    """(key, row) of all keys of the sets, and how many rare n-grams each set has."""
    level = classes.of(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    rare = np.ones(len(flat), bool)
    if len(frequent) and len(flat):
        rare = frequent[np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)] != flat
    keys, rows = [], []

    def take(key_of, which, owner, scheme, cls):
        total, place = key_of
        tag = place[which] + (cls[owner[which]] * 2 + scheme).astype(np.uint64) * np.uint64(1 << 32)
        keys.append(K.mix(total[which] + K.mix(tag)))
        rows.append(owner[which])

    for up in (0, 1):
        cls = level + up
        can = (sizes > 0) & (classes.most[cls] > 0)
        parts = np.where(can, classes.parts[cls], 0)
        enough = classes.parts[cls] - classes.most[cls]
        use = can[row] & rare
        total, held, owner, place = _dealt(flat[use], row[use], parts)
        take((total, place), held > 0, owner, 0, cls)
        empty = np.bincount(owner[held == 0], minlength=len(sizes))
        some = can & (empty >= enough)
        if some.any():  # by all n-grams, and by empty parts if still too many are
            use = some[row]
            total, held, owner, place = _dealt(flat[use], row[use], np.where(some, parts, 0))
            empty = np.bincount(owner[held == 0], minlength=len(sizes))
            take((total, place), (held > 0) | (empty >= enough)[owner], owner, 1, cls)
    return (np.concatenate(keys), np.concatenate(rows), np.bincount(row[rare], minlength=len(sizes))) if keys else None


def _groups(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)


def _pair_up(key, ids, rare, label, alone: bool):
    """(x, rare of p, p), at most one for each x, of documents in order of (key, rare, id): each with the plainest of another component.

    alone: every document is a component yet; pivots are then paired with themselves, to show that they meet others.
    """
    cuts = _groups(key)
    size = np.diff(cuts)
    lead = np.repeat(cuts[:-1], size)
    other = label != label[lead]
    group = np.repeat(np.arange(len(size)), size)
    if alone:
        x = np.flatnonzero(size[group] > 1)
        p = lead[x]
    else:
        at = np.flatnonzero(other)
        second = np.full(len(size), -1)
        g, first = np.unique(group[at], return_index=True)
        second[g] = at[first]
        x = np.flatnonzero((second[group] >= 0) & (lead != np.arange(len(key))))
        p = np.where(other[x], lead[x], second[group[x]])
    xi, rp, pi = ids[x], rare[p], ids[p]
    order = np.lexsort((pi, rp, xi))
    order = order[np.concatenate([[True], xi[order][1:] != xi[order][:-1]])] if len(order) else order
    return xi[order], rp[order], pi[order]


def _send(n: int, lower: bool, scheme, buckets: int, labelled: bool):
    """Rows (bucket, keys, ids, rare, labels) of packed keys; buckets below 0 hold pairs (x, p) that met here already."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, count = [], 0
        names = ["keys", "ids", "rare", "labels"]

        def flush():
            key, ids, rare, label = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, rare, key))
            key, ids, rare, label = key[order], ids[order], rare[order], label[order]
            size = np.diff(_groups(key))
            hot = np.repeat(size > LOCAL, size)
            if hot.any():
                x, rp, p = _pair_up(key[hot], ids[hot], rare[hot], label[hot], not labelled)
                pairs = Packer(2 * buckets, names)
                yield from pairs.add(-1 - bucket_of(K.mix(x.view(np.uint64)), buckets), p, x, rp, p)
                yield from pairs.rest()
                k, l = key[hot], (label if labelled else np.zeros_like(label))[hot]
                again = np.lexsort((np.arange(len(k)), l, k))  # the plainest of each component goes on
                new = np.concatenate([[True], (k[again][1:] != k[again][:-1]) | (l[again][1:] != l[again][:-1])])
                stay = np.sort(np.concatenate([np.flatnonzero(~hot), np.flatnonzero(hot)[again[new]]]))
                key, ids, rare, label = key[stay], ids[stay], rare[stay], label[stay]
            pack = Packer(buckets, names)
            yield from pack.add(bucket_of(key, buckets), key & np.uint64((1 << 40) - 1), ids, rare, label if labelled else np.zeros_like(label))
            yield from pack.rest()

        for batch, buf, offs in text_chunks(batches):
            flat, sizes, (s1, s2) = _sets(batch, buf, offs, n, lower)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            label = batch.column("label").to_numpy(zero_copy_only=False) if labelled else ids
            order = np.lexsort((ids, s2, s1))  # of equal sets in a chunk the one with the smallest id
            once = np.zeros(len(ids), bool)
            once[order] = np.concatenate([[True], (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])]) if len(order) else True
            flat, sizes, ids, label = flat[np.repeat(once, sizes)], sizes[once], ids[once], label[once]
            if (found := scheme.keys(flat, sizes)) is None or not len(found[0]):
                continue
            key, row, rare = found
            held.append((key, ids[row], rare[row].astype(np.int32), label[row]))
            count += len(key)
            if count >= FLUSH:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    return run


def _pivots(labelled: bool):
    """Of a bucket: (x, rare, p), x with the plainest pivot; with labels also, x and p null, keys with several components."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, ids, rare, label = (unpack(table, c, t) for c, t in (("keys", np.uint64), ("ids", np.int64), ("rare", np.int32), ("labels", np.int64)))
        loose = np.zeros(0, np.int64)
        if key[0].as_py() < 0:
            x, rp, p = ids, rare, keys.view(np.int64)
        else:
            if not labelled:
                label = ids
            order = np.lexsort((ids, rare, keys))
            keys, ids, rare, label = keys[order], ids[order], rare[order], label[order]
            x, rp, p = _pair_up(keys, ids, rare, label, not labelled)
            if labelled and len(keys):
                cuts = _groups(keys)[:-1]
                many = np.minimum.reduceat(label, cuts) < np.maximum.reduceat(label, cuts)
                loose = keys[cuts[many]].view(np.int64)
        none = pa.nulls(len(loose), pa.int64())
        return pa.table({
            "x": pa.chunked_array([pa.array(x, pa.int64()), none]), "rare": pa.chunked_array([pa.array(rp.astype(np.int64)), none]),
            "p": pa.chunked_array([pa.array(p, pa.int64()), none]), "loose": pa.chunked_array([pa.nulls(len(x), pa.int64()), pa.array(loose)]),
        })

    return run


def _filter(keys: DataFrame) -> np.ndarray | None:
    """A filter of the keys (loose), two bits for each, in 64-bit words; it grows with them up to FILTER bits. None without keys."""
    keys = keys.where("loose is not null").select("loose").distinct()
    if not (n := keys.count()):
        return None
    size = min(FILTER, 1 << max(16, (KEY_BITS * n - 1).bit_length()))
    bits = keys.select(F.explode(F.array("loose", F.shiftright("loose", 12))).alias("bit")).withColumn("bit", F.col("bit").bitwiseAND(F.lit(size - 1)))
    words = bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("m")).toArrow()  # at most FILTER / 64
    out = np.zeros(size // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return out.view(np.uint64)


def _may_hold(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys, cut to 40 bits, the filter may hold."""
    on = np.ones(len(key), bool)
    for h in (key, key >> np.uint64(12)):
        at = h & np.uint64(64 * len(words) - 1)
        on &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return on


def _parities(flat: np.ndarray, sizes: np.ndarray):
    """Of each set the parities of the n-grams that fall in 64 * PARITY bits; where its words begin in those of at least a bit for two n-grams, how many, and these; sets differ in at least as many n-grams as bits.

    The many words folded on PARITY of them, one over the other, are the few.
    """
    many = PARITY << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / (128 * PARITY)))).astype(np.int64)
    first = np.cumsum(many) - many
    row = np.repeat(np.arange(len(sizes)), sizes)
    words = np.zeros(many.sum(), np.uint64)
    np.bitwise_xor.at(words, first[row] + ((flat >> np.uint64(6)) % many[row].astype(np.uint64)).astype(np.int64), np.uint64(1) << (flat & np.uint64(63)))
    owner = np.repeat(np.arange(len(sizes)), many)
    few = np.zeros((len(sizes), PARITY), np.uint64)
    np.bitwise_xor.at(few, (owner, (np.arange(len(words)) - first[owner]) % PARITY), words)
    return few, first, many, words


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ..., n of each, one after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Finer:
    """Parities of large sets beyond the PARITY words that rows hold."""

    def __init__(self, ids: np.ndarray, few: np.ndarray, of: np.ndarray, at: np.ndarray, word: np.ndarray):
        order = np.lexsort((at, of))
        order = order[np.concatenate([[True], (of[order][1:] != of[order][:-1]) | (at[order][1:] != at[order][:-1])])] if len(order) else order
        of, at, word = of[order], at[order], word[order]
        sets, start, more = np.unique(of, return_index=True, return_counts=True)
        many = more + PARITY
        first = np.cumsum(many) - many
        self.words = np.zeros(many.sum(), np.uint64)
        self.words[_spans(first + PARITY, more)] = word
        seen, row = np.unique(ids, return_index=True)
        fold = few[row[np.searchsorted(seen, sets)]] if len(sets) else few[:0]
        np.bitwise_xor.at(fold, (np.repeat(np.arange(len(sets)), more), at.astype(np.int64) % PARITY), word)
        self.words[_spans(first, np.full(len(sets), PARITY))] = fold.ravel()
        place = np.minimum(np.searchsorted(sets, ids), len(sets) - 1)
        known = sets[place] == ids if len(sets) else np.zeros(len(ids), bool)
        self.first, self.many = (np.where(known, x[place], d) if len(sets) else np.full(len(ids), d) for x, d in ((first, 0), (many, PARITY)))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A lower bound of how many n-grams the sets of rows x and y differ in, 0 where one of them has no further words."""
        out = np.zeros(len(x), np.int64)
        p, q = self.many[x], self.many[y]
        for n, m in np.unique(np.stack([p, q], 1)[np.minimum(p, q) > PARITY], axis=0).tolist():
            rows, w = np.flatnonzero((p == n) & (q == m)), min(n, m)
            for i in range(0, len(rows), step := max(1, (1 << 20) // max(n, m))):
                r = rows[i : i + step]
                u, v = (np.bitwise_xor.reduce(self.words[self.first[at[r], None] + np.arange(k)].reshape(len(r), k // w, w), axis=1) for at, k in ((x, n), (y, m)))
                out[r] = np.bitwise_count(u ^ v).sum(1, dtype=np.int64)
        return out


def _first_keys(key: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Of each row its FIRST smallest keys, filled up with NONE."""
    out = np.full((rows, FIRST), NONE, np.uint64)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    at = np.arange(len(row)) - np.searchsorted(row, row)
    out[row[at < FIRST], at[at < FIRST]] = key[at < FIRST]
    return out


def _made_here(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of documents with first keys a and b are made at these keys, cut to 40 bits: at the smallest that both hold, or at every one if they hold none in common."""
    out = np.ones(len(key), bool)
    for i in range(0, len(key), BLOCK):
        x, y = a[i : i + BLOCK], b[i : i + BLOCK]
        same = (x[:, :, None] == y[:, None, :]).any(2) & (x != NONE)
        first = np.where(same, x, NONE).min(1)
        out[i : i + BLOCK] = ~same.any(1) | (first & np.uint64((1 << 40) - 1) == key[i : i + BLOCK])
    return out


#: Columns of keys that may have several components, and of the further parities of the sets that have them in a bucket.
KEYED, FURTHER = ["keys", "ids", "labels", "sizes", *(f"p{k}" for k in range(PARITY)), *(f"f{k}" for k in range(FIRST))], ["of", "at", "word"]


def _send_loose(n: int, lower: bool, scheme, buckets: int, loose: np.ndarray):
    """Keys that may have several components, with what bounds a pair's overlap; a set's further parities come once to each bucket."""

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.array([b""] * batch.num_rows, pa.binary())
        have = dict(zip(batch.schema.names, batch.columns, strict=True))
        return pa.RecordBatch.from_pydict({c: have.get(c, none) for c in ["bucket", *KEYED, *FURTHER]})

    def run(batches: Iterator[pa.RecordBatch]):
        pack, further = Packer(buckets, KEYED), Packer(buckets, FURTHER)
        for batch, buf, offs in text_chunks(batches):
            flat, sizes, _ = _sets(batch, buf, offs, n, lower)
            if (found := scheme.keys(flat, sizes)) is None or not len(found[0]):
                continue
            key, row, _ = found
            on = _may_hold(loose, key & np.uint64((1 << 40) - 1))
            first = _first_keys(key[on], row[on], len(sizes))
            key, row = key[on], row[on]
            few, start, many, words = _parities(flat, sizes)
            ids, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            bucket = bucket_of(key, buckets)
            yield from map(whole, pack.add(bucket, key & np.uint64((1 << 40) - 1), ids[row], label[row], sizes[row], *(few[row, k] for k in range(PARITY)), *(first[row, k] for k in range(FIRST))))
            large = many[row] > PARITY
            to, of = np.divmod(np.unique(bucket[large].astype(np.int64) * len(sizes) + row[large]), len(sizes))
            more = many[of] - PARITY
            place = _spans(start[of] + PARITY, more)
            yield from map(whole, further.add(np.repeat(to, more).astype(np.int32), np.repeat(ids[of], more), (place - np.repeat(start[of], more)).astype(np.int32), words[place]))
        yield from map(whole, pack.rest())
        yield from map(whole, further.rest())

    return run


def _cross(bound: Bound, nearest: bool = False):
    """(a, b) of a bucket: all pairs of different components with one key whose sizes and parities allow a link, if they are made at this key.

    nearest: of each document's pairs in a key only the one whose parities are least apart.
    """

    def run(table: pa.Table) -> pa.Table:
        key, ids, label, size = (unpack(table, c, t) for c, t in (("keys", np.uint64), ("ids", np.int64), ("labels", np.int64), ("sizes", np.int64)))
        par, held = (np.stack([unpack(table, f"{c}{k}", np.uint64) for k in range(m)], 1) for c, m in (("p", PARITY), ("f", FIRST)))
        order = np.lexsort((label, key))
        key, ids, label, size, par, held = key[order], ids[order], label[order], size[order], par[order], held[order]
        finer = Finer(ids, par, *(unpack(table, c, t) for c, t in zip(FURTHER, (np.int64, np.int32, np.uint64), strict=True)))
        out = [np.zeros((0, 2), np.int64)]

        def made(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> None:
            """Adds those pairs of rows, whose few parities allow a link, that are made here."""
            far = np.maximum(apart, finer.apart(x, y))
            may = far <= bound.differ(size[x] + size[y])
            x, y, far = x[may], y[may], far[may]
            if nearest:
                x, y = _nearest(x, y, far)
            here = _made_here(key[x], held[x], held[y])
            out.append(np.sort(np.stack([ids[x[here]], ids[y[here]]], 1), axis=1))

        cuts = _groups(key)
        rows = np.diff(cuts)
        mixed = np.flatnonzero(label[cuts[:-1]] != label[cuts[1:] - 1]) if len(key) else np.zeros(0, np.int64)
        few = mixed[rows[mixed] <= TOGETHER]
        run_of = np.cumsum(rows[few] * (rows[few] - 1) // 2) // PAIRS
        for g in np.split(few, np.flatnonzero(np.diff(run_of)) + 1):  # small groups by the hundred, so that none costs a call
            at = _spans(cuts[g], rows[g])
            after = np.repeat(cuts[g + 1], rows[g]) - 1 - at
            x, y = np.repeat(at, after), _spans(at + 1, after)
            ok = (label[x] != label[y]) & (np.minimum(size[x], size[y]) * bound.q >= bound.p * np.maximum(size[x], size[y]))
            x, y = x[ok], y[ok]
            apart = np.bitwise_count(par[x] ^ par[y]).sum(1, dtype=np.int64)
            ok = apart <= bound.differ(size[x] + size[y])
            if ok.any():
                made(x[ok], y[ok], apart[ok])
        for lo, hi in zip(*(cuts[mixed[rows[mixed] > TOGETHER] + k].tolist() for k in (0, 1)), strict=True):
            for i in range(lo, hi, BLOCK):
                a = slice(i, min(hi, i + BLOCK))
                for j in range(i, hi, BLOCK):
                    b = slice(j, min(hi, j + BLOCK))
                    ok = label[a, None] < label[None, b]
                    big, less = np.maximum(size[a, None], size[None, b]), np.minimum(size[a, None], size[None, b])
                    ok &= less * bound.q >= bound.p * big
                    if ok.any():
                        apart = sum(np.bitwise_count(par[a, None, k] ^ par[None, b, k]).astype(np.int64) for k in range(PARITY))
                        ok &= apart <= bound.differ(big + less)
                        x, y = np.nonzero(ok)
                        if len(x):
                            made(i + x, j + y, apart[x, y])
        pair = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})

    return run


def _nearest(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (x, y) those that are the least far ones of their x or of their y."""
    stay = np.zeros(len(x), bool)
    for end, other in ((x, y), (y, x)):
        order = np.lexsort((other, far, end))
        stay[order] |= np.concatenate([[True], end[order][1:] != end[order][:-1]]) if len(order) else False
    return x[stay], y[stay]


def masked_overlaps(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, ia: np.ndarray, ib: np.ndarray, bound: Bound) -> np.ndarray:
    """Which pairs (ia, ib) of rows of two incidence matrices, given as flat sorted sets and sizes, link.

    The product is formed for these pairs only, a block of columns at a time; a pair whose count and remaining
    entries can't reach its bound takes no part in further blocks.
    """
    least = bound.overlap(na[ia] + nb[ib])
    vocab, column = np.unique(a, return_inverse=True)
    if not len(vocab):
        return np.zeros(len(ia), bool)
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    entry = ra * len(vocab) + column
    at = np.minimum(np.searchsorted(vocab, b), len(vocab) - 1)
    some = vocab[at] == b
    at, rb, block = at[some], rb[some], (b[some] >> np.uint64(61)).astype(np.int64) * COLUMNS // 8
    left_a = np.bincount(ra * COLUMNS + (a >> np.uint64(61)).astype(np.int64) * COLUMNS // 8, minlength=len(na) * COLUMNS).reshape(len(na), COLUMNS)
    left_b = np.bincount(rb * COLUMNS + block, minlength=len(nb) * COLUMNS).reshape(len(nb), COLUMNS)
    first = np.concatenate([[0], np.cumsum(left_b.ravel())])[:-1].reshape(left_b.shape)
    count, live = np.zeros(len(ia), np.int64), np.arange(len(ia))
    rest_a, rest_b = left_a[:, ::-1].cumsum(1)[:, ::-1], left_b[:, ::-1].cumsum(1)[:, ::-1]
    for k in range(COLUMNS):
        live = live[count[live] + np.minimum(rest_a[ia[live], k], rest_b[ib[live], k]) >= least[live]]
        if not len(live):
            break
        many = left_b[ib[live], k]
        total = int(many.sum())
        pair = np.repeat(np.arange(len(live)), many)
        place = first[ib[live], k][pair] + np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        want = ia[live][pair] * len(vocab) + at[place]
        hit = entry[np.minimum(np.searchsorted(entry, want), len(entry) - 1)] == want
        count[live] += np.bincount(pair[hit], minlength=len(live))
    return (count >= least) & (na[ia] > 0) & (nb[ib] > 0)


def _verify(n: int, lower: bool, bound: Bound):
    def run(table: pa.Table) -> pa.Table:
        """(a, b) that link, of rows (a, salt, id, text): the pivot a itself and its partners."""
        a, salt, ids = (table.column(c).to_numpy() for c in ("a", "salt", "id"))
        buf, offs = texts_of(table.column("text"))
        s, e, d = K.words(buf, offs)
        flat, sizes = K.shingle_sets(K.span_hashes(buf, s, e, lower), d, len(ids), n)
        own = ids == a
        pivots, partners = np.flatnonzero(own), np.flatnonzero(~own)
        order = pivots[np.lexsort((salt[pivots], a[pivots]))]
        where = {(int(a[r]), int(salt[r])): k for k, r in enumerate(order.tolist())}
        ia = np.array([where.get((int(a[r]), int(salt[r])), -1) for r in partners], np.int64)
        partners, ia = partners[ia >= 0], ia[ia >= 0]
        ends = np.concatenate([[0], np.cumsum(sizes)])

        def of(rows):
            return (np.concatenate([flat[ends[r] : ends[r + 1]] for r in rows]) if len(rows) else flat[:0]), sizes[rows]

        hit = masked_overlaps(*of(order), *of(partners), ia, np.arange(len(partners)), bound)
        return pa.table({"a": pa.array(a[partners[hit]], pa.int64()), "b": pa.array(ids[partners[hit]], pa.int64())})

    return run


class Parts:
    """How documents of one class of candidates meet, and what is known of a pair without its texts: parts and parities."""

    #: Passes over keys with several components: the nearest pairs only, or all.
    steps = (True, False)

    def __init__(self, bound: Bound, frequent: np.ndarray):
        self.bound, self.frequent, self.classes = bound, frequent, Classes(bound)

    def keys(self, flat: np.ndarray, sizes: np.ndarray):
        """(key, row) of all keys of the sets, and how plain each set is; None without any."""
        return _part_keys(flat, sizes, self.classes, self.frequent)

    def signatures(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Of each set as many bits as n-grams, rounded up to 64 times a power of two, each the parity of those that fall there."""
        bits = 64 << np.ceil(np.log2(np.maximum(sizes, 64) / 64)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(bits)])
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = first[row] + ((flat >> np.uint64(6)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
        odd = np.packbits((np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8), bitorder="little")
        return [odd[x // 8 : y // 8].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def likely(self, x: bytes, y: bytes, nx: int, ny: int) -> bool:
        """Whether sets of these signatures and sizes may link."""
        return _apart(x, y) <= self.bound.differ(nx + ny)


def _signatures(n: int, lower: bool, scheme):
    """(id, size, sig) of each document."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, buf, offs in text_chunks(batches):
            flat, sizes, _ = _sets(batch, buf, offs, n, lower)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(scheme.signatures(flat, sizes), pa.binary())], names=["id", "size", "sig"])

    return run


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of how many n-grams two sets differ in; the longer signature is folded to the shorter's length."""
    p, q = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _likely(bound: Bound, scheme):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ok = np.minimum(na, nb) * bound.q >= bound.p * np.maximum(na, nb)
            for k in np.flatnonzero(ok).tolist():
                ok[k] = scheme.likely(batch.column("sa")[k].as_py(), batch.column("sb")[k].as_py(), int(na[k]), int(nb[k]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def _links(pairs: DataFrame, texts: DataFrame, sigs: DataFrame, n: int, lower: bool, bound: Bound, scheme) -> DataFrame:
    """Those (a, b) of pairs that link, written.

    Sizes and signatures, far smaller than texts, come first and pass what can link; only its texts are sent. A pivot
    with more than its share of pairs is dealt to several tasks.
    """
    spark = pairs.sparkSession
    buckets = bucket_count(spark)
    x = pairs.join(dealt(sigs.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("sig").alias("sa"))), "a")
    x = x.join(dealt(sigs.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("sig").alias("sb"))), "b")
    pairs = materialize(x.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_likely(bound, scheme), "a long, b long"), "likely")
    share = max(BLOCK, pairs.count() // buckets)
    hot = spark.createDataFrame(pairs.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > share).collect(), "a long, m long")  # at most one for each bucket
    x = pairs.join(F.broadcast(hot), "a", "left").withColumn("nb", F.coalesce(F.ceil(F.col("m") / share), F.lit(1)))
    left = x.select("a", "nb").distinct().select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("salt"), F.col("a").alias("id"))
    right = x.select("a", F.pmod(F.xxhash64("b"), "nb").alias("salt"), F.col("b").alias("id"))
    rows = left.unionByName(right).join(dealt(texts.select("id", "text")), "id").withColumn("task", F.pmod(F.xxhash64("a", "salt"), F.lit(buckets)))
    out = materialize(rows.groupBy("task").applyInArrow(_verify(n, lower, bound), "a long, b long"), "links")
    discard(pairs)
    return out


def _frequent(light: DataFrame, documents: int) -> np.ndarray:
    """Hashes of the n-grams that one document in ONE_IN has, sorted; at most FREQUENT, which only bounds the table."""
    often = light.where("id is null").groupBy(F.col("s1").alias("h")).agg(F.sum("s2").alias("m")).where(F.col("m") >= max(4, documents // ONE_IN))
    return np.sort(np.array([r.h for r in often.orderBy(F.desc("m"), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (8, 10), lower: bool = True, scheme=Parts) -> DataFrame:
    """(id, n_shingles, representative, component_id) of every row of docs.

    Two rows link when p/q * |union| <= |intersection| of their sets of n-word shingles, threshold = (p, q);
    component_id is the smallest id reachable over links. A text with 1 to n-1 words has its word sequence as its one
    shingle. A null or empty text, or one without words, has no shingles, links with nothing and is its own
    component. lower: A-Z count as a-z. Ids are taken as unique longs; rows with a null id are left out. Other
    columns are ignored, whatever their names. An empty table gives an empty result. Exact but for 64-bit hashes.

    Hot groups: equal sets fall together in each chunk, near copies meet their pivot in each flush of a map task, and
    a pivot with more than its share of pairs is dealt to several tasks. Only documents of a key that the pivots leave
    in several components are compared with each other. scheme: how candidates meet and are filtered.
    """
    spark, bound = docs.sparkSession, Bound(*threshold)
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    light = materialize(src.mapInArrow(_sketch(n, lower), "id long, n long, s1 long, s2 long"), "light")
    rows = light.where("id is not null")
    how = scheme(bound, _frequent(light, rows.count()))
    copies = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("m")).where("m > 1")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("m")
    members = rows.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(dealt(copies), ["n", "s1", "s2", "salt"], "left")
    members = materialize(members.select("id", "n", F.coalesce("rep", "id").alias("rep")), "members")
    discard(light)
    buckets = bucket_count(spark)
    reps = members.where("id = rep and n > 0").select("id")
    packed, paired = "bucket int, keys binary, ids binary, rare binary, labels binary", "x long, rare long, p long, loose long"

    def best(found: DataFrame) -> DataFrame:
        return found.where("x is not null").groupBy("x").agg(F.min(F.struct("rare", "p")).alias("to")).select(F.col("to.p").alias("a"), F.col("x").alias("b"))

    met = src.mapInArrow(_send(n, lower, how, buckets, False), packed).groupBy("bucket").applyInArrow(_pivots(False), paired)
    met = materialize(best(met).join(dealt(reps.withColumnRenamed("id", "b")), "b", "left_semi").select("a", "b"), "met")
    wanted = met.select(F.col("b").alias("id")).unionByName(met.select(F.col("a").alias("id"))).distinct()
    texts = materialize(src.join(dealt(wanted), "id", "left_semi"), "texts")
    sigs = materialize(texts.mapInArrow(_signatures(n, lower, how), "id long, size long, sig binary"), "sigs")
    # A pivot that met its documents in a map task may be a copy of its representative.
    same = met.select(F.col("a").alias("id")).distinct().join(dealt(members), "id").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = _links(met.where("a <> b"), texts, sigs, n, lower, bound, how).unionByName(same)
    label = components(links)
    open_texts = materialize(texts.join(dealt(label.select(F.col("v").alias("id"), "c")), "id", "left").select("id", "text", F.coalesce("c", "id").alias("label")), "labelled")
    again = materialize(open_texts.mapInArrow(_send(n, lower, how, buckets, True), packed).groupBy("bucket").applyInArrow(_pivots(True), paired), "again")
    if (loose := _filter(again)) is not None:
        links = links.unionByName(_links(best(again).where("a <> b"), texts, sigs, n, lower, bound, how))
        label = components(links)
        # Components that many pairs tie are tied by the nearest ones first, so that only pairs of what stays apart are left.
        for nearest in how.steps:
            left = open_texts.drop("label").join(dealt(label.select(F.col("v").alias("id"), "c")), "id", "left").select("id", "text", F.coalesce("c", "id").alias("label"))
            sent = left.mapInArrow(_send_loose(n, lower, how, buckets, loose), "bucket int, " + ", ".join(f"{c} binary" for c in [*KEYED, *FURTHER]))
            more = materialize(sent.groupBy("bucket").applyInArrow(_cross(bound, nearest), "a long, b long").distinct(), "more")
            if more.limit(1).count():
                found = _links(more, texts, sigs, n, lower, bound, how)
                if found.limit(1).count():
                    links = links.unionByName(found)
                    label = components(links)
            discard(more)
    discard(met, open_texts, again, texts, sigs)
    out = members.join(dealt(label.select(F.col("v").alias("rep"), "c")), "rep", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.col("rep").alias("representative"), F.coalesce("c", "rep").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = ngram_components(docs, n=3, threshold=(9, 10))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
