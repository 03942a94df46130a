"""Listing, following a folder, and upkeep that writes what changes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.model import EDGES, NODES, PropertyGraph
from graphloom.operators import cluster as C
from graphloom.sources import files, listing
from graphloom.streaming import incremental as I

EVENT = "path string, kind string, content string, ts timestamp"


def graph_of(rows):
    """A node for each word of a content and for the file, an edge from the file to each and from each word to the next."""
    x = rows.select("path", F.split("content", " ").alias("w")).select("path", F.posexplode(F.filter("w", lambda w: w != "")).alias("n", "word"))
    words = x.groupBy("word").agg(F.max("path").alias("file_path"), F.max("n").alias("n")).select(F.col("word").alias("id"), F.concat(F.lit("l"), F.col("n").cast("string")).alias("label"), "file_path")
    own = rows.select(F.concat(F.lit("file:"), "path").alias("id"), F.col("path").alias("label"), F.col("path").alias("file_path"))
    edges = x.select(F.concat(F.lit("file:"), "path").alias("src"), F.col("word").alias("dst"), F.lit("has").alias("relationship"), F.lit(1.0).alias("weight")).distinct()
    return PropertyGraph.of(words.unionByName(own), edges)


def state(g):
    return sorted((r.id, r.label, r.file_path) for r in g.nodes.collect()), sorted((r.src, r.dst, r.relationship, r.weight) for r in g.edges.collect())


def folded(spark, batches):
    """The same batches one after the other on whole graphs."""
    g, known = PropertyGraph.empty(spark), {}
    for batch in batches:
        last = {p: (k, c) for p, k, c, _ in batch}
        gone = [(p,) for p, (k, _) in last.items() if k == "deleted"]
        new = [(p, c) for p, (k, c) in last.items() if k != "deleted" and known.get(p) != c]
        for p, (k, c) in last.items():
            known[p] = c if k != "deleted" else None
        if gone:
            g = I.delete_paths(g, spark.createDataFrame(gone, "path string"))
        g = g.merge(graph_of(spark.createDataFrame(new, "path string, content string")))
        g = PropertyGraph(spark.createDataFrame(g.nodes.collect(), NODES), spark.createDataFrame(g.edges.collect(), EDGES))
    return g


def test_log_merges_to_what_whole_graphs_give(spark, tmp_path):
    r = random.Random(3)
    batches = []
    for _ in range(5):
        paths = r.sample([f"f{k}.py" for k in range(8)], 4)
        batches.append([(p, "deleted" if r.random() < 0.25 else "changed", " ".join(r.choices("abcdefghij", k=3)), None) for p in paths])
    batches = [[(p, k, None if k == "deleted" else c, t) for p, k, c, t in b] for b in batches]
    m = I.Maintainer(spark, str(tmp_path / "g"), graph_of, delete=True, compact=3)
    for k, b in enumerate(batches):
        m.apply(spark.createDataFrame(b, EVENT), k)
    assert m.version == 4 and m._complete("base") == [2]
    want = state(folded(spark, batches))
    assert state(m.load()) == want
    assert state(m.load(3)) == state(folded(spark, batches[:4]))
    m.compact()
    m.vacuum()
    assert sorted(os.listdir(tmp_path / "g")) == ["base4", "v4"] and state(m.load()) == want
    again = I.Maintainer(spark, str(tmp_path / "g"), graph_of, delete=True)
    again.apply(spark.createDataFrame(batches[4], EVENT), 4)  # the batch comes again
    assert again.version == 4


def written(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    m = I.Maintainer(spark, str(tmp_path / "g"), graph_of, delete=True, compact=0)
    r = random.Random(1)
    text = lambda k: " ".join(f"w{k}_{r.randrange(10**9)}" for _ in range(40))
    m.apply(spark.createDataFrame([(f"f{k}.py", "created", text(k), None) for k in range(400)], EVENT), 0)
    for k in range(1, 3):
        m.apply(spark.createDataFrame([(f"f{k}.py", "changed", text(k), None)], EVENT), k)
    first, second, third = (written(tmp_path / "g" / f"v{k}") for k in range(3))
    assert second < 0.1 * first and third < 0.1 * first
    changed = [spark.read.parquet(str(tmp_path / "g" / "v2" / t)).count() for t in ("nodes", "edges", "hashes")]
    assert changed == [41, 40, 1]


def test_communities_are_kept_beside_the_nodes(spark, tmp_path):
    m = I.Maintainer(spark, str(tmp_path / "g"), graph_of, C.detect, compact=2)
    m.apply(spark.createDataFrame([("a.py", "created", "x y z", None), ("b.py", "created", "p q", None)], EVENT), 0)
    m.apply(spark.createDataFrame([("b.py", "changed", "p q r", None)], EVENT), 1)
    g = m.load()
    want = {r.id: r.community for r in C.detect(g).collect()}
    assert {r.id: r.community for r in g.nodes.collect()} == want and len(want) == 8
    m.apply(spark.createDataFrame([("c.py", "created", "s", None)], EVENT), 2)
    assert {r.id for r in spark.read.parquet(str(tmp_path / "g" / "v2" / "communities")).collect()} == {"file:c.py", "s"}


def test_a_damaged_cache_raises(spark, tmp_path):
    c = I.Cache(spark, str(tmp_path / "cache"))
    assert c.rows().count() == 0
    c.put(spark.createDataFrame([("k", "h", "p")], "key string, content_hash string, payload string"), 1)
    part = next(p for p in (tmp_path / "cache").iterdir() if p.suffix == ".parquet")
    part.write_bytes(part.read_bytes()[:20])
    (tmp_path / "cache" / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        c.rows().count()


def make(root, *names, text="x"):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_skipped_folders_are_not_listed_and_underscores_are_found(spark, tmp_path, monkeypatch):
    make(tmp_path, "pkg/__init__.py", "_private/a.py", "node_modules/deep/b.js", "target/c.rs", "My_VENV/d.py", ".git/e.py", "pkg/.hidden.py", "z.py", "pkg/sub/y.md")
    seen = []
    inner = listing.entries
    monkeypatch.setattr(listing, "entries", lambda system, folder: seen.append(os.path.relpath(folder, tmp_path)) or inner(system, folder))
    rows, todo = listing.walk(str(tmp_path))
    assert sorted(seen) == [".", "_private", "pkg", "pkg/sub"] and todo == []
    assert sorted(r[1] for r in rows) == ["_private/a.py", "pkg/__init__.py", "pkg/sub/y.md", "z.py"]
    assert [r.relative_path for r in files.detect_files(spark, str(tmp_path)).collect()] == ["_private/a.py", "pkg/__init__.py", "pkg/sub/y.md", "z.py"]


def test_tasks_list_what_the_driver_leaves(spark, tmp_path, monkeypatch):
    make(tmp_path, *[f"d{a}/e{b}/f{c}.py" for a in range(4) for b in range(3) for c in range(2)], "top.py")
    monkeypatch.setattr(listing, "FOLDERS", 3)
    got = files.listed_files(spark, str(tmp_path))
    assert got.count() == 25 and {r.relative_path for r in got.where("language = 'Python'").collect()} >= {"top.py", "d3/e2/f1.py"}


def test_large_and_unknown_files_are_left_out(spark, tmp_path):
    make(tmp_path, "a.py", "b.unknown")
    make(tmp_path, "c.py", text="y" * 3000)
    got = files.detect_files(spark, str(tmp_path), max_bytes=1000).collect()
    assert [(r.relative_path, bytes(r.content)) for r in got] == [("a.py", b"x")]


def test_differences():
    old = {"a": [1, 1], "b": [2, 2], "c": [3, 3], "d": [4, 4], "e": [4, 4]}
    new = {"a": [1, 1], "b": [2, 9], "k": [3, 3], "m": [4, 4], "n": [5, 5]}
    assert listing.differences(old, new) == [("changed", "b", None), ("deleted", "c", None), ("deleted", "d", None), ("deleted", "e", None), ("renamed", "k", "c"), ("created", "m", None), ("created", "n", None)]


def test_a_folder_as_a_stream(spark, tmp_path):
    root, got = tmp_path / "src", []
    make(root, "a.py", "b/c.py", "skip.bin", "node_modules/x.py")
    events = listing.folder_changes(spark, str(root), str(tmp_path / "state"), (".py",))

    def run():
        got.clear()
        q = events.writeStream.foreachBatch(lambda df, k: got.extend((r.path, r.kind, r.former, r.content) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(got, key=repr)

    assert run() == [("a.py", "created", None, "x"), ("b/c.py", "created", None, "x")]
    (root / "b" / "c.py").rename(root / "b" / "d.py")
    make(root, "a.py", text="changed")
    make(root, "e.py", text="new")
    assert run() == [("a.py", "changed", None, "changed"), ("b/c.py", "deleted", None, None), ("b/d.py", "renamed", "b/c.py", "x"), ("e.py", "created", None, "new")]
    (root / "e.py").unlink()
    seen = (root / "a.py").stat()
    make(root, "a.py", text="CHANGED")
    os.utime(root / "a.py", ns=(seen.st_atime_ns, seen.st_mtime_ns))  # equal size and time: it isn't opened
    assert run() == [("e.py", "deleted", None, None)]
    assert run() == []
