"""The star graph's edges merged by number, with keys that are null, repeated or lead nowhere."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators import analyze as A
from graphloom.operators import metrics as M
from graphloom.operators import traverse as T
from graphloom.operators.build import merge_edges
from graphloom.sources import relational as R
from graphloom.sources import sinks as S


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("star"))
    rows = {
        "region": ([(0, "A"), (1, "B")], "r_regionkey int, r_name string"),
        "nation": ([(0, "x", 0), (1, "y", 7)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "c1", 0, "AUTO"), (2, "c2", 9, "AUTO"), (2, "c2", 0, "AUTO"), (None, "c", 0, "AUTO")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "supplier": ([(1, "s1", 0), (2, "s2", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": ([(k, f"p{k}", "Brand#1") for k in range(4)], "p_partkey long, p_name string, p_brand string"),
        "orders": ([(1, 1), (2, 2), (3, 8), (4, None)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(o, p, s, n, float(q), f, l) for o, p, s, n, q, f, l in [(1, 0, 1, 1, 5, "R", "O"), (1, 0, 1, 2, 6, "N", "F"), (2, 0, 1, 1, 7, "A", "F"), (2, 9, 1, 2, 1, "A", "O"), (3, 1, 2, 1, 2, "R", "O"), (4, 2, 5, 1, 3, "N", "O"), (5, 3, 2, 1, 4, "N", "F"), (1, None, 1, 3, 4, "N", "F"), (1, 3, None, 4, 4, None, None)]], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_edges_are_those_of_the_raw_rows(spark, star):
    cols = ["src", "dst", "relationship", "weight", "confidence_ord", "metadata"]
    want = merge_edges(R.star_edges(spark, star), R.star_nodes(spark, star)).select(*cols).collect()
    got = R.star_graph(spark, star).edges.select(*cols).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 8


def test_unique_edges_are_neither_shuffled_for_it_nor_sought_among_nodes(spark, star, monkeypatch):
    monkeypatch.setattr(R, "LINES", 2)
    g = R.star_graph(spark, star)
    plan = M.adjacency(g)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(src#\d+, dst#\d+, relationship", plan) and "hashpartitioning(b#" in plan


def test_tasks_grow_with_lines(spark, star, monkeypatch):
    monkeypatch.setattr(R, "LINES", 2)
    plan = R.star_graph(spark, star).edges._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(b#\d+L?, 5\)", plan)


def test_expand_of_few_nodes_sends_them_to_the_edges(spark, star, monkeypatch):
    g = R.star_graph(spark, star)
    ask = lambda: sorted(map(tuple, T.expand(g, g.nodes.where(F.col("id").isin("supplier:1", "customer:1")).select("id")).collect()))
    few = ask()
    monkeypatch.setattr(T, "BROADCAST", -1)
    assert few == ask() and ("part:0", 1) in few and ("region:0", 2) in few
    monkeypatch.setattr(T, "LAZY", 0)
    assert [r.id for r in T.shortest_path(g, "supplier:1", "region:0").orderBy("step").collect()] == ["supplier:1", "nation:0", "region:0"]


def test_a_loops_table_has_the_size_of_its_files(spark):
    from graphloom.model import cut

    x = spark.range(100)
    for _ in range(6):
        x = cut(x.join(x.withColumnRenamed("id", "b"), x.id == F.col("b")).select("id"))
    assert int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 64
    assert x.count() == 100


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_meet_their_orders_in_tasks_that_grow(spark, star, monkeypatch):
    monkeypatch.setattr(R, "LINES", 2)
    assert len(re.findall(r"hashpartitioning\(line#\d+L?, 5\)", plan_of(R.star_graph(spark, star).edges))) == 2


def test_large_tables_are_dealt_and_not_sent(spark, star, monkeypatch):
    ask = lambda: sorted(map(repr, R.star_graph(spark, star).edges.collect()))
    few = ask()
    monkeypatch.setattr(R, "FEW", 0)
    monkeypatch.setattr(R, "LINES", 2)
    assert few == ask()


def test_sides_are_the_nodes_attributes(spark, star):
    g, want = R.star_graph(spark, star), {"community": F.col("community"), "label": F.col("label")}
    cols = ["src", "dst", "relationship", "weight", "confidence_ord", "src_community", "dst_community", "src_label", "dst_label"]
    ask = lambda g: sorted(map(repr, g.sided(want).where("src <> 'customer:2'").select(*cols).collect()))  # customer 2 is there twice
    assert ask(g) == ask(PropertyGraph(g.nodes, g.edges)) == ask(g.settled(**want)) and len(ask(g)) > 5


def one_of_each(g):
    """The graph without the customer that is there twice."""
    rest = lambda df: df.where("src <> 'customer:2'")
    return replace(g, nodes=g.nodes.where("id <> 'customer:2'"), edges=rest(g.edges), sides=lambda want: rest(g.sides(want)))


@pytest.mark.parametrize("name", ["wiki_articles", "questions", "vault_notes", "bridges", "bridge_nodes", "cohesion_report"])
def test_edges_are_made_once_with_the_same_results(spark, star, name):
    g, made = one_of_each(R.star_graph(spark, star)), []
    run = next(getattr(m, name) for m in (S, A, M) if hasattr(m, name))
    ask = lambda g: sorted(map(repr, run(g).collect()))
    bad = g.edges.where(F.raise_error(F.lit("edges are made again")).isNull())
    counted = replace(g, edges=bad if name in ("wiki_articles", "questions") else g.edges, sides=lambda want: (made.append(want), g.sides(want))[1])
    assert ask(counted) == ask(PropertyGraph(g.nodes, g.edges, True, True)) and len(made) == 1


def test_a_vaults_lines_are_shuffled_by_their_own_node_alone(spark, star):
    assert "hashpartitioning(other#" not in plan_of(S.vault_notes(R.star_graph(spark, star)))


def test_a_store_of_sides_is_that_of_the_graph(spark, star):
    from graphloom.sources.store import GraphStore

    g = one_of_each(R.star_graph(spark, star))
    both = [GraphStore.save(x, f"sides_{k}", buckets=2) for k, x in enumerate((g, PropertyGraph(g.nodes, g.edges, True, True)))]
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(both[0].ends) == rows(both[1].ends) and rows(both[0].nodes) == rows(both[1].nodes) and rows(both[0].ends)
    for b in both:
        b.drop()


def test_a_fold_is_dealt_to_tasks_that_grow(spark, star, monkeypatch):
    from graphloom.plans.graph_queries import QUERIES

    monkeypatch.setattr(R, "LINES", 2)
    assert re.search(r"hashpartitioning\(id#\d+, 5\)", plan_of(QUERIES["graph_node_merge_fold"](spark, star)))
