"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_spread_communities_of_places_are_as_good_as_sequential_ones(spark):
    from graphloom.operators import cluster, metrics
    from graphloom.plans.text_queries import _located

    g = _located(spark, SF)
    spread, one = (metrics.modularity(g.with_communities(x)).first().modularity for x in (registry.queries()["cluster_spread"](spark, SF), cluster.detect(g)))
    assert spread >= 0.99 * one > 0.5
