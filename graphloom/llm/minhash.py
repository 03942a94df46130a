"""MinHash near-dedup by bottom-k sketches of one hash function.

A document's sketch has the KEEP smallest hashes of its shingles. Documents meet in inverted lists of retained values.
A single value's list would have all documents that share one common passage, so lists are kept of RUN values that
follow each other in the FILED smallest. Two sets with u shingles together and at most u / 5 of them in one set alone
always share such a run if all of them are filed (runs of two in the smallest sets); of large sets, whose sketch is a
random part of the union, they do but for a chance of 1e-10 at a similarity of 0.8, and less above. A run whose
values one document in 512 has all of is left out, unless most of a document is made of such values.

Of each list the plainest document is the pivot, and each document goes with its plainest pivot, so that pairs grow
with documents and not with the square of a list. A pair's union sketch, the KEEP smallest values of both, estimates
the similarity by how many of these both have; pairs too far below the threshold go. Exact Jaccard over the whole sets
verifies the rest, and only links that pass tie documents together. Lists that are still in several components are
compared further, as in the n-gram join, which shares these steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .ngram_join import Bound, ngram_components

#: Values in a sketch; those of it that are filed; values in a run.
KEEP, FILED, RUN = 256, 64, 3
#: Standard deviations that an estimate may fall short of the threshold.
SIGMAS = 6.5
#: With a smaller share of runs that have a rare value a document files all its runs.
ENOUGH = 0.6


def order(flat: np.ndarray) -> np.ndarray:
    """The one hash function, a bijection of the shingles' hashes."""
    return K.mix(flat ^ np.uint64(0xA5A5A5A5))


def sketches(flat: np.ndarray, sizes: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keep smallest values of each set, in order, flat; how many each has; and the places in flat they come from."""
    value = order(flat)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.lexsort((value, row))
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    at = at[np.arange(len(flat)) - first[row] < keep]
    return value[at], np.minimum(sizes, keep), at


def estimate(x: np.ndarray, y: np.ndarray, keep: int) -> tuple[int, int]:
    """How many of the keep smallest values of both sketches both have, and how many there are."""
    union = np.union1d(x, y)[:keep]
    return int((np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)).sum()), len(union)


class Sketches:
    """Candidates by runs of retained values, filtered by union sketches."""

    steps = (False,)

    def __init__(self, bound: Bound, frequent: np.ndarray):
        if 5 * bound.p < 4 * bound.q:
            raise ValueError("runs of three find links of 0.8 and more")
        self.bound, self.frequent = bound, frequent

    def keys(self, flat: np.ndarray, sizes: np.ndarray):
        """(key, row) of the runs of each sketch, and how many rare values it has; sets of fewer values file all of them as one run."""
        if not len(flat):
            return None
        value, n, at = sketches(flat, sizes, FILED)
        rare = np.ones(len(value), bool)
        if len(self.frequent):
            own = flat[at]
            rare = self.frequent[np.minimum(np.searchsorted(self.frequent, own), len(self.frequent) - 1)] != own
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        row = np.repeat(np.arange(len(n)), n)
        begin = np.arange(len(value)) - first[row]
        keys, starts, somes = [], [], []
        for size in (RUN, RUN - 1):
            if size == RUN:
                runs = np.flatnonzero((begin + RUN <= n[row]) | (begin == 0))
            else:  # of two sets with five values together the four that both have may lie two and two
                runs = np.flatnonzero((begin + size <= n[row]) & (n[row] <= RUN + 2))
            key, some = np.full(len(runs), size, np.uint64), np.zeros(len(runs), bool)
            for j in range(size):
                place = np.minimum(runs + j, len(value) - 1)
                on = (place == runs + j) & (row[place] == row[runs])
                key = K.mix(key * np.uint64(0xD6E8FEB86659FD93) + np.where(on, value[place], np.uint64(j)))
                some |= on & rare[place]
            keys.append(key)
            starts.append(runs)
            somes.append(some)
        key, runs, some = (np.concatenate(x) for x in (keys, starts, somes))
        owner = row[runs]
        many = np.bincount(owner, minlength=len(n))
        with_rare = np.bincount(owner[some], minlength=len(n))
        stay = some | (with_rare < ENOUGH * many)[owner]
        return key[stay], owner[stay], np.bincount(row[rare], minlength=len(n))

    def signatures(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        value, n, _ = sketches(flat, sizes, KEEP)
        ends = np.concatenate([[0], np.cumsum(n)]).tolist()
        return [value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def likely(self, x: bytes, y: bytes, nx: int, ny: int) -> bool:
        """Whether the union sketch's estimate leaves a link possible; it is exact for sets that their sketches hold whole."""
        both, n = estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), KEEP if max(nx, ny) > KEEP else nx + ny)
        t = self.bound.p / self.bound.q
        if max(nx, ny) <= KEEP:
            return both * self.bound.q >= self.bound.p * n
        return both >= t * n - SIGMAS * np.sqrt(t * (1 - t) * n)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, threshold: tuple[int, int] = (8, 10), lower: bool = True) -> DataFrame:
    """(id, n_shingles, representative, component_id, kept) of every row of docs.

    Two rows link when p/q * |union| <= |intersection| of their sets of n-word shingles, threshold = (p, q); a text
    with 1 to n-1 words has its word sequence as its one shingle. component_id is the smallest id reachable over links,
    and kept says that it is the row's own. A null or empty text, or one without words, has no shingles, links with
    nothing and is kept. lower: A-Z count as a-z. Ids are taken as unique longs; rows with a null id are left out.
    Other columns are ignored, whatever their names. An empty table gives an empty result. Every link that counts is
    confirmed on full sets; a link is lost with the chance stated above, for thresholds of 0.8 and more.
    """
    out = ngram_components(docs, id_col, text_col, n=n, threshold=threshold, lower=lower, scheme=Sketches)
    return out.withColumn("kept", F.col("id") == F.col("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    out = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
