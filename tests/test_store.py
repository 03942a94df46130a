"""A stored graph answers as the graph does, without moving its edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators import metrics as M
from graphloom.operators import query as Q
from graphloom.operators import traverse as T
from graphloom.sources.store import GraphStore


def some_graph(spark, seed=1, n=60):
    r = random.Random(seed)
    nodes = [(f"n{k:02d}", r.choice(["Auth Service", "Store", "Main Entry", None]), r.choice(["Class", "File", "Document"]), f"src/f{k % 7}.py", r.choice([0, 1, 2, None])) for k in range(n)]
    edges = [(f"n{r.randrange(n - 5):02d}", f"n{r.randrange(n - 3):02d}", r.choice(["uses", "calls"]), float(r.randint(1, 5)), r.randrange(3)) for _ in range(150)]
    edges += [("n01", "n01", "uses", 1.0, 0), ("n02", "gone", "uses", 1.0, 0), ("gone", "n03", "calls", 1.0, 1), *edges[:10]]
    e = spark.createDataFrame(edges, "src string, dst string, relationship string, weight double, confidence_ord int")
    return PropertyGraph.of(spark.createDataFrame(nodes, "id string, label string, type string, file_path string, community int").repartition(3), e.repartition(5))


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    g = some_graph(spark)
    # Of edges with equal keys any may stand for all in a graph; here they are told apart by none of their columns.
    e = g.edges.groupBy("src", "dst", "relationship").agg(F.count("*").alias("n"), F.max("weight").alias("weight"), F.min("confidence_ord").alias("confidence_ord"))
    e = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    g = PropertyGraph(g.nodes.persist(), PropertyGraph.of(g.nodes, e).edges.persist())
    folder = str(tmp_path_factory.mktemp("store") / "g")
    return g, GraphStore.save(g, "told", folder, buckets=4), folder


def rows(df):
    return sorted((tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in df.collect()), key=repr)


def test_search(both):
    g, s, _ = both
    for term in ("auth", "n0", "CLASS", "nothing"):
        assert rows(s.search(term)) == rows(Q.search(g, term))
    assert rows(s.search("n", limit=30, connections=2)) == rows(Q.search(g, "n", limit=30, connections=2))
    with pytest.raises(ValueError):
        s.search("  ")
    with pytest.raises(ValueError):
        s.search("n", connections=21)


def test_explain(both):
    g, s, _ = both
    for node in ("n00", "n01", "n02", "n59", "gone", "none"):
        assert rows(s.explain(node)) == rows(Q.explain(g, node))
        assert rows(s.explain_edges(node)) == rows(Q.explain_edges(g, node))


def test_paths(both, monkeypatch):
    g, s, _ = both
    near = T.expand(g, g.node("n00").select("id"), 3).collect()
    far = sorted(near, key=lambda r: (-r.hop, r.id))[0].id
    for a, b in (("n00", far), ("n59", "n00"), ("n00", "gone")):
        want = rows(T.shortest_path(g, a, b))
        assert rows(s.shortest_path(a, b)) == want
    monkeypatch.setattr("graphloom.sources.store.FEW", 0)  # frontiers are joined
    assert rows(s.shortest_path("n00", far)) == rows(T.shortest_path(g, "n00", far))


def test_communities_and_analysis(both):
    g, s, _ = both
    assert rows(s.communities_overview()) == rows(Q.communities_overview(g))
    assert rows(s.members(1)) == rows(Q.community_members(g, 1))
    assert rows(s.statistics(1)) == rows(M.statistics(g))
    mine, want = s.analyze(), Q.analyze(g)
    assert set(mine) == set(want)
    for k in want:
        assert rows(mine[k]) == rows(want[k]), k
    assert rows(s.edges()) == rows(g.edges.drop("metadata"))


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture
def told(spark):
    """Plans that say which buckets are read, and no broadcasts."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_questions_about_a_node_read_one_bucket_and_hops_move_no_edges(both, told):
    _, s, _ = both
    for df in (s.explain("n01"), s.explain_edges("n01"), s.hop(None, ["n01"])):
        text = plan(df)
        assert "SelectedBucketsCount: 1 out of 4" in text and "Join" not in text and "hashpartitioning" not in text
    assert "told_ends" not in plan(s.search("auth")) and "told_ends" not in plan(s.communities_overview())
    frontier = s.spark.range(1000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))
    text = plan(s.hop(frontier))
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1 and "SortMergeJoin" in text  # the frontier's


def test_another_session_opens_the_store(both, told):
    g, _, folder = both
    s = GraphStore.open(g.nodes.sparkSession, "again", folder)
    assert rows(s.explain_edges("n01")) == rows(Q.explain_edges(g, "n01"))
    assert "SelectedBucketsCount: 1 out of 4" in plan(s.explain_edges("n01"))
    with pytest.raises(FileNotFoundError):
        GraphStore.open(g.nodes.sparkSession, "no", folder + "-none")


def test_an_empty_graph_is_stored(spark):
    s = GraphStore.save(PropertyGraph.empty(spark), "void")
    assert s.search("x").count() == 0 and s.explain("x").count() == 0 and s.shortest_path("a", "b").count() == 0
    assert s.statistics().first().edge_count == 0 and s.communities_overview().count() == 0
    s.drop()
