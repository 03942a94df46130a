"""Graph fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from graphloom.model import EDGES, NODES, PropertyGraph
from graphloom.operators import analyze as A
from graphloom.operators import build as B
from graphloom.operators import cluster as C
from graphloom.operators import metrics as M
from graphloom.operators import query as Q
from graphloom.operators import traverse as T


def graph(spark, nodes, edges):
    n = [(i, i.upper(), "Entity", p, None, None, 0, c, {}) for i, p, c in nodes]
    e = [(a, b, r, float(w), k, {}) for a, b, r, w, k in edges]
    return PropertyGraph(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_degree_counts_self_loops_twice_and_parallel_edges(spark):
    g = graph(spark, [("a", "a.py", 0), ("b", "b.py", 0), ("c", "c.py", None)], [("a", "a", "x", 1, 0), ("a", "b", "x", 1, 0), ("a", "b", "y", 2, 1)])
    assert rows(M.degrees(g), "id", "degree") == [("a", 4), ("b", 2), ("c", 0)]
    assert rows(M.adjacency(g), "id", "other", "weight") == [("a", "a", 1.0), ("a", "b", 3.0), ("b", "a", 3.0)]


def test_statistics(spark):
    g = graph(spark, [("a", "f.py", 0), ("b", "f.py", 0), ("c", "f.py", 0), ("d", "f.py", 0)], [("a", "b", "x", 1, 0), ("b", "c", "x", 1, 0)])
    r = M.statistics(g).first()
    assert (r.node_count, r.edge_count, r.community_count, r.average_degree, r.isolated_node_count) == (4, 2, 1, 1.0, 3)
    assert M.statistics(PropertyGraph.empty(spark)).first().average_degree == 0.0


def test_builder_merges_weights_confidence_and_labels(spark):
    cols = "id string, label string, file_type string, source_file string, source_location string, metadata map<string,string>, ord long"
    nodes = spark.createDataFrame([("a", "First", "Code", "F.cs", "L1", {"x": "1", "y": "1"}, 0), ("a", "Second", "Code", "F.cs", None, {"x": "2"}, 1), ("b", "B", "Code", "F.cs", None, None, 2)], cols)
    edges = spark.createDataFrame([("a", "b", "calls", 1.0, 2, "F.cs", 0), ("a", "b", "calls", 2.0, 0, "F.cs", 1), ("a", "zz", "calls", 1.0, 0, "F.cs", 2)], "src string, dst string, relationship string, weight double, confidence_ord int, source_file string, ord long")
    g = B.build(nodes, edges, with_files=False)
    a = g.node("a").first()
    assert a.label == "Second" and a.metadata == {"x": "2", "merge_count": "2"}
    e = g.edges.collect()
    assert len(e) == 1 and (e[0].weight, e[0].confidence_ord, e[0].metadata["merge_count"]) == (3.0, 0, "2")
    assert B.build(nodes, edges, strategy="aggregate").node("a").first().metadata == {"x": "2", "y": "1", "merge_count": "2"}
    full = B.build(nodes, edges)
    assert full.nodes.count() == 3 and full.edges.count() == 3
    light = B.build(nodes, edges, min_weight=2.0)
    assert light.nodes.count() == 3 and light.edges.count() == 1


def test_merge_drops_edges_of_replaced_nodes_unless_told(spark):
    g = graph(spark, [("a", "f", 0), ("b", "f", 0), ("c", "f", 0)], [("a", "b", "x", 1, 0), ("b", "c", "x", 1, 0)])
    other = graph(spark, [("a", "g", 1)], [])
    assert rows(g.merge(other).edges, "src", "dst") == [("b", "c")]
    assert rows(g.merge(other, preserve_edges=True).edges, "src", "dst") == [("a", "b"), ("b", "c")]


def test_clusters_two_triangles_and_lone_nodes(spark):
    tri = lambda a, b, c: [(a, b, "x", 1, 0), (b, c, "x", 1, 0), (c, a, "x", 1, 0)]
    g = graph(spark, [(x, "f", None) for x in "abcdefz"], tri("a", "b", "c") + tri("d", "e", "f"))
    found = dict(rows(C.detect(g), "id", "community"))
    assert found["a"] == found["b"] == found["c"] == 0 and found["d"] == found["e"] == found["f"] == 1 and found["z"] == 2
    assert M.modularity(C.cluster(g)).first().modularity == 0.5
    lone = graph(spark, [("a", "f", None), ("b", "f", None)], [])
    assert rows(C.detect(lone), "id", "community") == [("a", 0), ("b", 1)]


def test_cohesion_variants(spark):
    full = graph(spark, [(x, "f", 0) for x in "abc"], [("a", "b", "x", 1, 0), ("b", "c", "x", 1, 0), ("a", "c", "x", 1, 0)])
    assert rows(M.cohesion_engine(full), "cohesion") == [(2.0,)] and rows(M.cohesion_report(full), "cohesion") == [(1.0,)] and rows(M.density(full), "density") == [(1.0,)]
    one = graph(spark, [("a", "f", 0)], [])
    assert rows(M.cohesion_engine(one), "cohesion") == [(1.0,)] and rows(M.cohesion_report(one), "cohesion") == [(0.0,)]


def test_surprise_and_questions(spark):
    g = graph(spark, [("a", "File1.cs", 0), ("b", "File1.cs", 0), ("c", "File2.cs", 1), ("d", "File2.cs", 1)], [("a", "b", "calls", 1, 0), ("c", "d", "calls", 1, 0), ("a", "c", "uses", 1, 1)])
    assert rows(A.surprise_scores(g), "src", "dst", "score") == [("a", "c", 5)]
    assert "no_signal" in [r.kind for r in A.questions(PropertyGraph.empty(spark)).collect()]


def test_paths_and_search(spark):
    g = graph(spark, [(x, "f", 0) for x in "abcd"], [("a", "b", "x", 1, 0), ("b", "c", "x", 1, 0)])
    assert rows(T.shortest_path(g, "a", "c"), "step", "id") == [(0, "a"), (1, "b"), (2, "c")]
    assert rows(T.shortest_path(g, "a", "a"), "step", "id") == [(0, "a")]
    assert T.shortest_path(g, "c", "a").count() == 0 and T.shortest_path(g, "a", "nowhere").count() == 0
    assert rows(T.expand(g, g.node("a").select("id"), 1), "id", "hop") == [("a", 0), ("b", 1)]
    assert Q.search(g, "B").first().connections == "x:a, x:c"
    with pytest.raises(ValueError):
        Q.search(g, " ")


def test_dangling_edges_are_not_added(spark):
    g = graph(spark, [("a", "f", 0)], [])
    e = graph(spark, [], [("a", "b", "x", 1, 0)]).edges
    assert g.add_edges(e).edges.count() == 0
    assert g.nodes.where(F.col("id") == "q").count() == 0
