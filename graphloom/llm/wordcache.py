"""Bounded caches from a word to what it encodes to; a process keeps them over its tasks."""

from __future__ import annotations

from collections.abc import Callable


#: A longer key is computed each time, so that a cache is bounded in bytes as well.
LONGEST = 64


class Cache(dict):
    """Fills up with what it is asked for first, which has the frequent keys; beyond the limit it only computes."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit and len(key) <= LONGEST:
            self[key] = value
        return value
