"""Extraction, cleaning, validation, files, renderings and upkeep."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.functions import validate as V
from graphloom.model import PropertyGraph
from graphloom.operators import build as B
from graphloom.operators import extract as X
from graphloom.operators import traverse
from graphloom.plans import pipeline
from graphloom.sources import files, semantic, sinks
from graphloom.streaming import incremental as I


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first().x


CASES = {
    "C#": ("Foo.cs", "using A.B;\n\nnamespace My.App\n{\npublic class Foo {\n  public abstract int Run(int x);\n}\n}\n", {("foo", "Foo.cs", "L1"), ("foo_my_app", "My.App", "L2"), ("foo_foo", "Foo", "L5"), ("foo_run", "Run()", "L6")}, {("b", "imports"), ("foo_my_app", "contains"), ("foo_foo", "contains"), ("foo_run", "contains")}),
    "python": ("m.py", "import os.path\nfrom x.y import z\nclass Aa:\n  pass\ndef ff(a):\n  pass\nclass B:\n  pass\n", {("m", "m.py", "L1"), ("m_aa", "Aa", "L3"), ("m_ff", "ff()", "L5")}, {("path", "imports"), ("y", "imports_from"), ("m_aa", "contains"), ("m_ff", "contains")}),
    "JavaScript": ("u.js", "import a from './lib/util.js'\nclass Aa {}\nexport async function ff(x) {}\nlet gg = (y) => 1\nvar hh = async (y) => 1\nexport const ii = (y) => 1\n", {("u", "u.js", "L1"), ("u_aa", "Aa", "L2"), ("u_ff", "ff()", "L3"), ("u_gg", "gg()", "L4"), ("u_hh", "hh()", "L5")}, {("util", "imports_from"), ("u_aa", "contains"), ("u_ff", "contains"), ("u_gg", "contains"), ("u_hh", "contains")}),
    "TypeScript": ("t.ts", "import { x } from \"../shared/api.client\"\nexport interface Shape {}\nclass Box {}\n", {("t", "t.ts", "L1"), ("t_shape", "Shape", "L2"), ("t_box", "Box", "L3")}, {("api", "imports_from"), ("t_shape", "contains"), ("t_box", "contains")}),
    "Go": ("g.go", "import 'net/http'\ntype Server struct {\n}\nfunc (s *Server) Serve(x int) {\n}\nfunc main() {\n}\n", {("g", "g.go", "L1"), ("g_server", "Server", "L2"), ("g_serve", "Serve()", "L4"), ("g_main", "main()", "L6")}, {("http", "imports"), ("g_server", "contains"), ("g_serve", "contains"), ("g_main", "contains")}),
    "Java": ("J.java", "import java.util.List;\nimport static java.lang.Math.max;\npublic enum Kind { }\npublic class Job {\n  public static void run(int x) {}\n}\n", {("j", "J.java", "L1"), ("j_kind", "Kind", "L3"), ("j_job", "Job", "L4"), ("j_run", "run()", "L5")}, {("list", "imports"), ("j_kind", "contains"), ("j_job", "contains"), ("j_run", "contains")}),
    "Rust": ("r.rs", "use std::collections::HashMap;\npub struct Point<T> {}\ntrait Draw {}\npub async fn go<T>(x: T) {}\n", {("r", "r.rs", "L1"), ("r_point", "Point", "L2"), ("r_draw", "Draw", "L3"), ("r_go", "go()", "L4")}, {("hashmap", "imports"), ("r_point", "contains"), ("r_draw", "contains"), ("r_go", "contains")}),
    "c": ("a.c", "#include <lib/std.io.h>\nstatic int main(void) {\n  if (x) {\n  }\n}\n", {("a", "a.c", "L1"), ("a_main", "main()", "L2")}, {("std_io", "imports"), ("a_main", "contains")}),
    "C++": ("p.cpp", "#include \"box.hpp\"\nclass Shape {\n};\nstruct Size {\n};\nint area(int x) {\n}\n", {("p", "p.cpp", "L1"), ("p_shape", "Shape", "L2"), ("p_size", "Size", "L4"), ("p_area", "area()", "L6")}, {("box", "imports"), ("p_shape", "contains"), ("p_size", "contains"), ("p_area", "contains")}),
}


@pytest.mark.parametrize("language", CASES)
def test_extraction(spark, language):
    path, text, nodes, edges = CASES[language]
    n, e = X.extract(spark.createDataFrame([(path, language, text), ("h.hs", "Haskell", "x")], "path string, language string, content string"))
    assert {(r.id, r.label, r.source_location) for r in n.collect()} == nodes
    assert {(r.dst, r.relationship) for r in e.collect()} == edges


def test_empty_file_is_its_node(spark):
    n, e = X.extract(spark.createDataFrame([("e.py", "Python", None)], "path string, language string, content string"))
    assert n.count() == 1 and e.count() == 0


@pytest.mark.parametrize(("url", "fine"), [("https://example.com", True), ("http://example.com/a?b", True), ("ftp://example.com", False), ("javascript:alert(1)", False), ("file:///etc/passwd", False), ("http://10.0.0.1", False), ("http://192.168.1.1/x", False), ("http://172.16.0.1", False), ("http://172.31.255.255", False), ("http://172.32.0.1", True), ("http://localhost:80", False), ("http://[::1]/", False), ("", False), (None, False), ("no scheme", False)])
def test_urls(spark, url, fine):
    assert (one(spark, V.url_errors(F.col("u")), u=url) == []) == fine


def test_payloads(spark):
    assert one(spark, V.payload(F.col("p")), p="not json") is None
    x = one(spark, V.payload(F.col("p")), p='```json\n{"nodes":[{"id":"A","label":"a"},{"id":"b","label":"onclick=x"}],"edges":[{"source":"a","target":"A","weight":-3}]}\n```')
    assert [n.id for n in x.nodes] == ["A"] and x.edges[0].weight == 0.0 and x.edges[0].relation == "related_to"


def test_extraction_errors(spark):
    n = spark.createDataFrame([("a", " ", "f")], "id string, label string, source_file string")
    e = spark.createDataFrame([("a", "q", "", "f")], "src string, dst string, relationship string, source_file string")
    assert {r.error for r in V.extraction_errors(n, e).collect()} == {"label is blank", "relation is blank", "target is unknown"}


def test_project_to_renderings(spark, tmp_path):
    src = tmp_path / "src"
    for name, text in {"a/m.py": "class Aa:\n  pass\ndef ff(x):\n  pass\n", "b.js": "class Bb {}\n", ".hidden/x.py": "class H:\n", "node_modules/y.js": "class N {}", "notes.tmp": "x"}.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
    found = files.detect_files(spark, str(src))
    assert sorted(r.relative_path for r in found.collect()) == ["a/m.py", "b.js"]
    assert files.detect_files(spark, str(src), exclude=("B.JS",)).count() == 1 and files.detect_files(spark, str(src), max_bytes=12).count() == 1
    out = tmp_path / "out"
    g, failed = pipeline.run(spark, str(src), str(out), tuple(sinks.FORMATS))
    assert failed == {}
    for name in ("graph.json", "graph.html", "graph.svg", "graph.cypher", "graph.ladybug.cypher", "GRAPH_REPORT.md"):
        assert (out / name).stat().st_size > 0
    data = json.loads((out / "graph.json").read_text())
    assert len(data["nodes"]) == g.nodes.count() == data["metadata"]["node_count"] == 7
    again = files.read_graph(spark, str(out / "graph.json"))
    assert again.nodes.count() == 7 and again.edges.count() == len(data["edges"])
    assert list(Path(out, "obsidian").glob("*.md")) and list(Path(out, "wiki").glob("*.md"))
    assert sinks.export(g, str(out), ("nonsense",)) == {"nonsense": "unknown format"}


def test_upkeep_by_stream(spark, tmp_path):
    schema = "path string, kind string, content string, ts timestamp"
    inbox = tmp_path / "in"
    rows = [("a.py", "created", "class Aa:\n  pass\n", "2024-01-01 00:00:00"), ("a.py", "changed", "class Bb:\n  pass\n", "2024-01-01 00:00:01"), ("x/bin/z.py", "created", "class Z:\n", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "path string, kind string, content string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(inbox))

    def extract(df):
        from graphloom.operators.build import build

        return build(*X.extract(df.select("path", F.lit("Python").alias("language"), "content")), with_files=False)

    m = I.Maintainer(spark, str(tmp_path / "g"), extract, delete=True)
    q = m.start(spark.readStream.schema(schema).parquet(str(inbox)), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert sorted(r.id for r in m.load().nodes.collect()) == ["a", "a_bb"]
    gone = spark.createDataFrame([("a.py", "deleted", None, None)], schema)
    m.apply(gone, m.version + 1)
    assert m.load().nodes.count() == 0


def test_maintainer_goes_on_after_a_restart(spark, tmp_path):
    def extract(rows):
        nodes, edges = X.extract(rows.withColumn("language", F.lit("Python")))
        return B.build(nodes, edges)

    def batch(*rows):
        return spark.createDataFrame(list(rows), "path string, kind string, content string, ts timestamp")

    folder = str(tmp_path / "g")
    m = I.Maintainer(spark, folder, extract)
    one, two = batch(("a.py", "changed", "class Aa:\n  pass\n", None)), batch(("b.py", "changed", "class Bb:\n  pass\n", None))
    m.apply(one, 0)
    m = I.Maintainer(spark, folder, extract)
    m.apply(two, 1)
    want = ["a", "a_aa", "b", "b_bb", "file:a.py", "file:b.py"]
    assert sorted(r.id for r in m.load().nodes.collect()) == want and m.version == 1
    I.Maintainer(spark, folder, extract).apply(two, 1)  # the same batch again
    m = I.Maintainer(spark, folder, extract)
    assert sorted(r.id for r in m.load().nodes.collect()) == want and m.version == 1


def test_watch_follows_a_folder(spark, tmp_path):
    root, out = tmp_path / "src", str(tmp_path / "out")
    root.mkdir()
    (root / "a.py").write_text("class Alpha:\n    pass\n")
    ids = lambda k: sorted(r.id for r in k.load().nodes.collect())
    assert ids(pipeline.watch(spark, str(root), out, ("json",), ticks=1)) == ["a", "a_alpha", "file:a.py"]
    (root / "b.go").write_text("func Run(x int) {\n}\n")
    again = pipeline.watch(spark, str(root), out, ("json",), ticks=2)
    assert ids(again) == ["a", "a_alpha", "b", "b_run", "file:a.py", "file:b.go"] and again.version == 1
    (root / "a.py").unlink()
    assert ids(pipeline.watch(spark, str(root), out, ("json",), ticks=1)) == ["b", "b_run", "file:b.go"]


def test_long_paths_are_found(spark):
    n = 66
    g = PropertyGraph.of(spark.createDataFrame([(f"n{k}", f"N{k}") for k in range(n + 1)], "id string, label string"), spark.createDataFrame([(f"n{k}", f"n{k + 1}", "to") for k in range(n)], "src string, dst string, relationship string"))
    assert traverse.shortest_path(g, "n0", f"n{n}").count() == n + 1
    with pytest.raises(ValueError):
        traverse.shortest_path(g, "n0", f"n{n}", max_hops=3)


def test_detection_passes_links_and_skipped_folders(spark, tmp_path):
    for name in ("z.py", "a/b.yaml", "vendor/c.go", "lib64/d.py", "x_venv/e.py", ".h/f.py", "a/.g.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    outside = tmp_path.parent / f"{tmp_path.name}-outside"
    outside.mkdir()
    (outside / "s.py").write_text("x")
    (tmp_path / "link").symlink_to(outside)
    (tmp_path / "q.py").symlink_to(outside / "s.py")
    got = [(r.relative_path, r.language, r.category) for r in files.detect_files(spark, str(tmp_path)).collect()]
    assert got == [("a/b.yaml", "YAML", "Code"), ("vendor/c.go", "Go", "Code"), ("z.py", "Python", "Code")]
    with pytest.raises(FileNotFoundError):
        files.detect_files(spark, str(tmp_path / "none"))


def test_changes_and_cache(spark, tmp_path):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, content string")
    known = now.where("path = 'a'").select("path", F.sha2("content", 256).alias("content_hash"))
    assert {(r.path, r.state) for r in I.changed(now, known).collect()} == {("b", "new"), ("c", "deleted")}
    c = I.Cache(spark, str(tmp_path / "cache"))
    c.put(spark.createDataFrame([("k", "h", "p")], "key string, content_hash string, payload string"), 1)
    want = lambda h: spark.createDataFrame([("k", h)], "key string, content_hash string")
    assert c.hits(want("h")).count() == 1 and c.hits(want("other")).count() == 0
    c.invalidate(want("h"), 2)
    assert c.rows().count() == 0


def test_empty_graph_renders(spark, tmp_path):
    g = PropertyGraph.empty(spark)
    assert sinks.export(g, str(tmp_path), ("json", "html", "svg", "report")) == {}


def test_semantic_rows_of_a_chat_model(spark, tmp_path):
    for name in ("a.py", "b.md", "c.png", "d.pdf", "e.go"):
        (tmp_path / name).write_text("x" if name != "e.go" else "y" * 3000)
    found = files.detect_files(spark, str(tmp_path))
    good = '{"nodes":[{"id":"k1","label":"Login","type":"Document","metadata":{"a":"b"}},{"id":"k2","label":"Store"}],"edges":[{"source":"k1","target":"k2","relation":"uses","confidence":"extracted","weight":0.4},{"source":"k1","target":"k2","weight":0.9}]}'

    def chat(prompt):
        if "a.py" in prompt:
            return f"```json\n{good}\n```"
        if "b.md" in prompt:
            raise RuntimeError("busy")
        return "no json"

    got = {r.path: r.answer for r in semantic.answers(found, chat, semantic.Options(most_bytes=1000)).collect()}
    assert set(got) == {"a.py", "b.md", "c.png", "d.pdf"} and got["b.md"] is None
    nodes, edges = semantic.extraction(semantic.answers(found, chat))
    assert {(r.id, r.label, r.file_type, r.source_file) for r in nodes.collect()} == {("k1", "Login", "Document", "a.py"), ("k2", "Store", "Code", "a.py")}
    assert [(r.src, r.dst, r.relationship, r.weight, r.confidence_ord) for r in edges.orderBy("ord").collect()] == [("k1", "k2", "uses", 0.4, 0), ("k1", "k2", "related_to", 0.9, 1)]
    assert [(r.source_file, r.scores) for r in semantic.confidence_scores(edges).collect()] == [("a.py", {"k1->k2": 0.9})]
    assert semantic.answers(found, None).count() == 0
    both = semantic.both(X.extract(files.texts(found)), (nodes, edges))
    assert both[0].count() == 4 and B.build(*both).nodes.where("id in ('k1', 'k2')").count() == 2
    assert semantic.totals(found, *both).first().asDict() == {"files": 5, "skipped": 3, "nodes": 4, "edges": 2}


def test_wiki_and_vault_have_their_indexes(spark, tmp_path):
    g = PropertyGraph.of(spark.createDataFrame([("a", "Big One", "Class", 0), ("b", "B", "Class", 0), ("c", "C", "File", 1)], "id string, label string, type string, community int"), spark.createDataFrame([("a", "b", "calls", 0), ("a", "c", "uses", 2), ("b", "a", "calls", 0)], "src string, dst string, relationship string, confidence_ord int"))
    assert sinks.export(g, str(tmp_path), ("wiki", "obsidian")) == {}
    article = (tmp_path / "wiki" / "Big_One.md").read_text()
    assert "> God node, 3 connections" in article and "### uses\n- [[C]] `ambiguous`" in article
    assert "- [[community-0]]: 2 nodes\n- [[community-1]]: 1 nodes" in (tmp_path / "wiki" / "index.md").read_text()
    index = (tmp_path / "obsidian" / "_Index.md").read_text()
    assert "- [[Big One]] (3 connections)" in index and "### Community 0" in index and "- Class: 2" in index
