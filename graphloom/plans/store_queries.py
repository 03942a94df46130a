"""Queries over a stored graph and over a graph kept up to date by a log, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..sources.relational import star_graph
from ..sources.store import GraphStore
from ..streaming.incremental import Maintainer
from . import graph_queries as G
from .text_queries import EVENTS, events

_STORES: dict[tuple[str, str], GraphStore] = {}


def stored(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The stored graph of the tables, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = GraphStore.save(star_graph(spark, sf_dir), f"star_{uuid.uuid4().hex[:12]}")
    return _STORES[key]


def _nodes_of(rows: DataFrame) -> PropertyGraph:
    """A node for each path that is labelled by its content's hash, one for the hash's first letter, and an edge between."""
    x = rows.select("path", F.sha2("content", 256).alias("h"))
    own = x.select(F.col("path").alias("id"), F.col("h").alias("label"), F.col("path").alias("file_path"))
    group = F.concat(F.lit("hash:"), F.substring("h", 1, 1))
    groups = x.select(group.alias("id"), group.alias("label")).distinct().withColumn("file_path", F.lit(None).cast("string"))
    edges = x.select(group.alias("src"), F.col("path").alias("dst"), F.lit("has").alias("relationship"), F.lit(1.0).alias("weight"))
    return PropertyGraph.of(own.unionByName(groups), edges)


def upkeep(spark: SparkSession, sf_dir: str, batches: int = 3) -> Maintainer:
    """Events as batches of changes, in order of time, applied one after the other to a log in the warehouse."""
    x = events(spark, sf_dir).select("path", "kind", "content", "ts")
    span = x.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b")).first()
    at = F.least(F.floor((F.col("ts").cast("double") - F.lit(span.a)) / F.lit(max(span.b - span.a, 1.0)) * batches), F.lit(batches - 1))
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/upkeep-{uuid.uuid4().hex}"
    keeper = Maintainer(spark, folder, _nodes_of, delete=True, compact=2)
    for k in range(batches):
        keeper.apply(x.where(at == k), k)
    return keeper


QUERIES = {
    "store_search": lambda s, d: stored(s, d).search("RIC"),
    "store_explain": lambda s, d: stored(s, d).explain("nation:3"),
    "store_explain_edges": lambda s, d: stored(s, d).explain_edges("nation:3"),
    "store_shortest_path": lambda s, d: stored(s, d).shortest_path("supplier:1", "region:" + str(G._region_of(s, d, 1))),
    "store_communities_overview": lambda s, d: stored(s, d).communities_overview(),
    "store_statistics": lambda s, d: stored(s, d).statistics(),
    "store_top_degree": lambda s, d: stored(s, d).top_degree(),
    "store_community_members": lambda s, d: stored(s, d).members(2),
    "store_edges_by_relationship": lambda s, d: stored(s, d).analyze()["edges_by_relationship"],
    "store_mean_weight": lambda s, d: stored(s, d).analyze()["mean_weight"],
    "store_insights": lambda s, d: stored(s, d).analyze()["insights"],
    "upkeep_nodes": lambda s, d: upkeep(s, d).load().nodes.where("file_path is not null").select("id", "label"),
}

ORACLES = {
    **{k: G.ORACLES[k.replace("store_", "graph_")] for k in QUERIES if k.startswith("store_") and k.replace("store_", "graph_") in G.ORACLES and k != "store_statistics"},
    "store_statistics": G.ORACLES["graph_statistics_no_edge"],
    "upkeep_nodes": EVENTS + "select path as id, sha256(content) as label from last where content is not null",
}
