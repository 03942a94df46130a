"""A graph's JSON file read by many tasks.

The file is cut into ranges of bytes. A task can't know whether its range begins inside a string, so a first pass counts
for each range its quotes and, for either case, by how much brackets outside strings go up; the sums over the ranges
before, a few numbers for each on the driver, then say how every range begins. A second pass finds the arrays that the
outer object opens, by key. In the third each task parses the elements that begin in its range, reading on past its
end for the last one. Names of an element's own keys count without case or underscores; metadata comes back as it is.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph, existing
from .listing import store

#: Bytes of a range, and bytes that are read on at a time for an element that goes on past it.
RANGE, MORE = 16 << 20, 1 << 16

_QUOTE, _BACK = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1

_NODE = "id string, label string, type string, file_path string, language string, community int, confidence string, metadata map<string,string>"
_EDGE = "source string, target string, relationship string, weight double, confidence string, metadata map<string,string>"


def _bytes(path: str, start: int, size: int) -> np.ndarray:
    system, at = store(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        return np.frombuffer(f.read(size), np.uint8)


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Where quotes are that no backslash escapes; escaped: an odd number of backslashes stands before data."""
    at = np.flatnonzero(data == _QUOTE)
    back = data == _BACK
    # How many backslashes end just before each place: since the last byte that is none.
    plain = np.flatnonzero(~back)
    last = np.searchsorted(plain, at) - 1
    run = np.where(last >= 0, at - 1 - plain[np.maximum(last, 0)] if len(plain) else 0, at + (1 if escaped else 0))
    return at[run % 2 == 0]


def _escaped(path: str, start: int) -> bool:
    """Whether an odd number of backslashes stands before start."""
    n = 0
    while start - n > 0 and _bytes(path, start - n - 1, 1)[0] == _BACK:
        n += 1
    return n % 2 == 1


class Scan:
    """Brackets of a piece of JSON outside strings: places, and the depth after each."""

    def __init__(self, data: np.ndarray, inside: bool, depth: int, escaped: bool = False):
        quotes = _quotes(data, escaped)
        at = np.flatnonzero(_STEP[data] != 0)
        odd = (np.searchsorted(quotes, at) + inside) % 2 == 1
        self.at = at[~odd]
        self.kind = data[self.at]
        self.depth = depth + np.cumsum(_STEP[self.kind], dtype=np.int64)
        self.inside = bool((len(quotes) + inside) % 2)
        self.end = int(self.depth[-1]) if len(self.depth) else depth

    def elements(self) -> tuple[np.ndarray, np.ndarray]:
        """Where objects in arrays of the outer object begin, and where objects there end."""
        opens = self.at[(self.kind == ord("{")) & (self.depth == 3)]
        return opens, self.at[(self.kind == ord("}")) & (self.depth == 2)] + 1

    def values(self) -> list[tuple[int, bool]]:
        """Where arrays and objects that the outer object has as values begin, and which are arrays."""
        on = (_STEP[self.kind] > 0) & (self.depth == 2)
        return list(zip(self.at[on].tolist(), (self.kind[on] == ord("[")).tolist(), strict=True))


def plain(name: str) -> str:
    return name.lower().replace("_", "")


def _key_before(path: str, at: int) -> str:
    """The key whose value begins at this place."""
    size = 256
    while True:
        text = _bytes(path, max(0, at - size), min(size, at)).tobytes().decode("utf-8", "replace")
        if found := re.search(r'"((?:[^"\\]|\\.)*)"\s*:\s*$', text):
            return plain(json.loads(f'"{found[1]}"'))
        if size > at:
            return ""
        size *= 4


def _ranges(spark: SparkSession, path: str) -> tuple[list[tuple[int, int, bool, int, str]], bool]:
    """(start, size, in a string, depth, key of the array) of each range, and whether the file ends as it should."""
    system, at = store(path)
    info = system.get_file_info(at)
    if not info.is_file:
        raise FileNotFoundError(f"no graph file at {path}")
    pieces = [(s, min(RANGE, info.size - s)) for s in range(0, info.size, RANGE)]
    df = spark.createDataFrame(pieces, "start long, size long").repartition(max(1, len(pieces)))

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, esc = _bytes(path, start, size), _escaped(path, start)
                out, into = Scan(data, False, 0, esc), Scan(data, True, 0, esc)
                yield pa.RecordBatch.from_pylist([{"start": start, "size": size, "flips": out.inside, "outside": out.end, "inside": into.end}])

    counted = sorted(df.mapInArrow(count, "start long, size long, flips boolean, outside long, inside long").collect(), key=lambda r: r["start"])  # a row for each range
    states, within, depth = [], False, 0
    for r in counted:
        states.append((r["start"], r["size"], within, depth))
        depth += r["inside"] if within else r["outside"]
        within = within != r["flips"]

    def keys(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start, size, inside, deep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [{"at": start + x, "key": _key_before(path, start + x) if array else ""} for x, array in Scan(_bytes(path, start, size), inside, deep, _escaped(path, start)).values()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("at", pa.int64()), ("key", pa.string())]))

    known = spark.createDataFrame(states, "start long, size long, inside boolean, depth int").repartition(max(1, len(states)))
    opened = sorted((r["at"], r["key"]) for r in known.mapInArrow(keys, "at long, key string").collect())  # one for each of the outer keys
    out = []
    for start, size, inside, deep in states:
        before = [k for at, k in opened if at < start]
        out.append((start, size, inside, deep, before[-1] if before else ""))
    head = _bytes(path, 0, 1024).tobytes().lstrip(b"\xef\xbb\xbf").lstrip()[:1]
    return out, head == b"{" and depth == 0 and not within


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _values(element: dict, names: dict[str, tuple[str, ...]], kinds: dict) -> dict:
    own = {}
    for k, v in element.items():
        own.setdefault(plain(k), v)
    out = {}
    for name, also in names.items():
        v = next((own[k] for k in also if own.get(k) is not None), None)
        if name == "metadata":
            v = None if not isinstance(v, dict) else [(k, _text(x)) for k, x in v.items()]
        elif kinds.get(name) is not None and v is not None:
            v = kinds[name](v)
        elif name not in kinds:
            v = _text(v)
        out[name] = v
    return out


_NAMES = {
    "nodes": {"id": ("id",), "label": ("label",), "type": ("type",), "file_path": ("filepath",), "language": ("language",), "community": ("community",), "confidence": ("confidence",), "metadata": ("metadata",)},
    "edges": {"source": ("source",), "target": ("target",), "relationship": ("relationship",), "weight": ("weight",), "confidence": ("confidence",), "metadata": ("metadata",)},
}
_MAP = pa.map_(pa.string(), pa.string())
_ARROW = {"community": pa.int32(), "weight": pa.float64(), "metadata": _MAP}


def _elements(path: str, wanted: str):
    names = _NAMES[wanted]
    schema = pa.schema([(n, _ARROW.get(n, pa.string())) for n in names])

    def rows(start: int, size: int, inside: bool, depth: int, key: str):
        data, esc = _bytes(path, start, size), _escaped(path, start)
        scan = Scan(data, inside, depth, esc)
        values = scan.values()
        arrays, labels = [x for x, _ in values], [_key_before(path, start + x) if array else "" for x, array in values]
        opens, ends = scan.elements()
        for x in opens.tolist():
            k = bisect_left(arrays, x) - 1
            if (labels[k] if k >= 0 else key) != wanted:
                continue
            j = int(np.searchsorted(ends, x, "right"))
            if j < len(ends):
                yield json.loads(data[x : ends[j]].tobytes())
                continue
            tail, more = data[x:], MORE  # the last one goes on past the range
            while True:
                tail = np.concatenate([data[x:], _bytes(path, start + size, more)])
                found = np.flatnonzero(Scan(tail, False, 0).depth == 0)
                if len(found):
                    yield json.loads(tail[: Scan(tail, False, 0).at[found[0]] + 1].tobytes())
                    break
                if len(tail) < len(data) - x + more:
                    raise ValueError(f"{path} ends within an element")
                more *= 2

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = []
                for element in rows(*state):
                    held.append(_values(element, names, {"community": int, "weight": float}))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from its JSON file, of any size; edges without ends are left out.

    Keys of nodes and edges count without case or underscores, the first of several that are alike; values that should
    be text and aren't come as JSON. A file that isn't there raises FileNotFoundError, one whose brackets or quotes
    don't close ValueError.
    """
    ranges, whole = _ranges(spark, path)
    if not whole:
        raise ValueError(f"{path} is not a JSON object")
    pieces = spark.createDataFrame(ranges, "start long, size long, inside boolean, depth int, key string").repartition(len(ranges))
    n = pieces.mapInArrow(_elements(path, "nodes"), _NODE)
    e = pieces.mapInArrow(_elements(path, "edges"), _EDGE)
    ord_ = lambda c: F.when(F.upper(c) == "AMBIGUOUS", 2).when(F.upper(c) == "INFERRED", 1).otherwise(0)
    nodes = n.select("id", "label", F.coalesce("type", F.lit("Entity")).alias("type"), "file_path", "language", "community", "metadata", ord_(F.col("confidence")).alias("confidence_ord"))
    edges = e.select(F.col("source").alias("src"), F.col("target").alias("dst"), "relationship", F.coalesce("weight", F.lit(1.0)).alias("weight"), ord_(F.col("confidence")).alias("confidence_ord"), "metadata")
    g = PropertyGraph.of(nodes, edges)
    return PropertyGraph(g.nodes, existing(g.edges, g.nodes))
