"""Array kernels over UTF-8 bytes: words, their hashes, and hashes of word windows.

Words are runs of bytes other than space and 0x09-0x0D. All hashes have 64 bits; two different words or windows
of a corpus of 10^9 distinct ones agree with a chance of about 3 percent for any pair at all.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of a word's last eight bytes or fewer, those that belong to it.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Spans of more bytes are hashed one by one.
_LONG = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word; gap: which bytes part words."""
    solid = ~gap[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = np.flatnonzero(np.diff(offs) > 0)
    first[offs[full]] = solid[offs[full]]
    last[offs[full + 1] - 1] = solid[offs[full + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of each span of bytes. lower: A-Z count as a-z.

    Eight bytes at a time go through a bijection, so that no pattern in a text brings two spans together; only
    chance does. A round takes the spans that have so many bytes; few are left after the second.
    """
    if lower:
        buf = _LOWER[buf]
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > _LONG)
    live, at = (np.flatnonzero((size > 0) & (size <= _LONG)), 0) if len(long) else (np.flatnonzero(size > 0), 0)
    while len(live):
        left = size[live] - at
        block = eight[starts[live] + at] & _TAIL[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ block)
        at += 8
        live = live[left > 8]
    for i in long.tolist():
        out[i] = int.from_bytes(blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; the caller discards those that cross documents."""
    m = max(0, len(h) - k + 1)
    out = np.full(m, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + m]
    return mix(out)


def inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k words lie in one document."""
    m = max(0, len(doc) - k + 1)
    return doc[:m] == doc[k - 1 : k - 1 + m]


def shingle_sets(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document, flat, and the size of each set.

    A document of 1 to k-1 words has its whole sequence as its one shingle, one without words the empty set.
    """
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)])
    grams, parts = gram_hashes(h, k), []
    for d in range(n_docs):
        n = counts[d]
        if n >= k:
            g = np.sort(grams[first[d] : first[d] + n - k + 1])
            parts.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif n:
            parts.append(gram_hashes(h[first[d] : first[d] + n], int(n)))
        else:
            parts.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, parts), np.int64, n_docs)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes
