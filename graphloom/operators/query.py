"""The five interactive queries over a loaded graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import rounded
from ..model import EDGE_KEY, PropertyGraph, confidence_name, ends
from .metrics import communities, degrees, histogram, statistics, top_degree, top_members, with_degree
from .traverse import shortest_path

__all__ = ["analyze", "communities_overview", "community_members", "community_totals", "explain", "explain_edges", "god_links", "insights", "search", "shortest_path"]


def search(g: PropertyGraph, term: str, limit: int = 10, connections: int = 5) -> DataFrame:
    """(id, label, type, degree, connections): nodes whose id, label or type has the term, by id; a blank term is an error."""
    if not term or not term.strip():
        raise ValueError("the search term is blank")
    low = F.lit(term.lower())
    hit = g.nodes.where(F.contains(F.lower("id"), low) | F.contains(F.lower("label"), low) | F.contains(F.lower("type"), low)).orderBy("id").limit(limit).select("id", "label", "type")
    d = degrees(PropertyGraph(hit, g.edges))
    x = ends(g.distinct_edges(), "relationship").join(hit.select("id"), "id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("other", "relationship"))
    near = x.withColumn("r", rank).where(F.col("r") <= connections).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.concat("relationship", F.lit(":"), "other").alias("t")))), lambda s: s["t"]), ", ").alias("connections"))
    return hit.join(d, "id").join(near, "id", "left").select("id", "label", "type", "degree", F.coalesce("connections", F.lit("")).alias("connections"))


def role() -> Column:
    """What a node of its type is called."""
    return F.when(F.col("type") == "File", "source file").when(F.col("type") == "Document", "document").when(F.col("type") == "Paper", "paper").when(F.col("type") == "Image", "image").otherwise(F.lower("type"))


def connectivity(total: Column) -> Column:
    """How a node with so many distinct edges, in and out, is called."""
    return F.when(total == 0, "isolated").when(total == 1, "connected once").when(total < 5, "lightly connected").when(total < 20, "well connected").otherwise("a hub")


def explain(g: PropertyGraph, node_id: str) -> DataFrame:
    """One row about a node: counts of distinct edges in and out, its role and how connected it is; none if it doesn't exist."""
    e = g.edges.where((F.col("src") == node_id) | (F.col("dst") == node_id)).dropDuplicates(EDGE_KEY)
    n = e.agg(F.count_if(F.col("dst") == node_id).alias("in_count"), F.count_if(F.col("src") == node_id).alias("out_count"))
    how = connectivity(F.col("in_count") + F.col("out_count"))
    return g.node(node_id).join(n).select("id", "label", "type", "file_path", "community", "in_count", "out_count", role().alias("role"), how.alias("connectivity"))


def explain_edges(g: PropertyGraph, node_id: str) -> DataFrame:
    """(direction, relationship, other, label, weight, confidence): a node's distinct edges; a loop is both in and out."""
    e = g.edges.where((F.col("src") == node_id) | (F.col("dst") == node_id)).dropDuplicates(EDGE_KEY)
    rows = [e.where(F.col(own) == node_id).select(F.lit(way).alias("direction"), "relationship", F.col(far).alias("other"), "weight", confidence_name(F.col("confidence_ord")).alias("confidence")) for way, own, far in (("in", "dst", "src"), ("out", "src", "dst"))]
    x = rows[0].unionByName(rows[1]).join(g.nodes.select(F.col("id").alias("other"), "label"), "other", "left")
    return x.select("direction", "relationship", "other", "label", "weight", "confidence").orderBy("direction", "relationship", "other")


def community_totals(g: PropertyGraph) -> DataFrame:
    """One row: communities, nodes in one, and nodes without."""
    return g.nodes.agg(F.count_distinct("community").alias("communities"), F.count("community").alias("members"), F.count_if(F.col("community").isNull()).alias("without"))


def god_links(g: PropertyGraph, n: int = 10, links: int = 20) -> DataFrame:
    """(id, relationship, total, rank, label, confidence): the links, at most so many of a relationship, of the n nodes of the highest degree.

    A node's links are its edges, in either direction, with nodes that it has an edge to; equal names and confidences
    fall together; those with the node of the highest degree come first, ties by id. total: links of the relationship.
    The n nodes are broadcast; two equi joins find their edges.
    """
    top = F.broadcast(top_degree(g, n).select("id"))
    out = g.edges.join(top, g.edges.src == top.id).select("id", F.col("dst").alias("other"), "relationship", "confidence_ord")
    back = g.edges.join(top, g.edges.dst == top.id).where("src <> dst").select("id", F.col("src").alias("other"), "relationship", "confidence_ord")
    known = out.select("id", "other").distinct()
    x = out.unionByName(back.join(known, ["id", "other"], "left_semi"))
    far = with_degree(g).select(F.col("id").alias("other"), F.col("label"), F.col("degree"))
    x = x.join(far, "other").groupBy("id", "relationship", "label", "confidence_ord").agg(F.min(F.struct((-F.col("degree")).alias("d"), "other")).alias("place"))
    own = Window.partitionBy("id", "relationship")
    x = x.withColumn("rank", F.row_number().over(own.orderBy("place", "confidence_ord"))).withColumn("total", F.count("*").over(own))
    return x.where(F.col("rank") <= links).select("id", "relationship", "total", "rank", "label", confidence_name(F.col("confidence_ord")).alias("confidence"))


def communities_overview(g: PropertyGraph, top: int = 5) -> DataFrame:
    """(community, size, members): the largest first, with the members of the highest degree."""
    m = top_members(g, top).groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]), ", ").alias("members"))
    return communities(g).join(m, "community").select("community", "size", "members").orderBy(F.desc("size"), "community")


def community_members(g: PropertyGraph, community: int) -> DataFrame:
    """(id, label, degree) of a community's nodes."""
    return with_degree(g).where(F.col("community") == community).select("id", "label", "degree")


def sentences(statistics: DataFrame, top: DataFrame) -> DataFrame:
    """(ord, insight): sentences about size, hub (the row of top), isolation and communities."""
    x = statistics.join(top.select(F.col("label").alias("hub"), F.col("degree").alias("hub_degree")), how="left")
    lines = [
        F.format_string("The graph has %d nodes and %d edges.", "node_count", "edge_count"),
        F.when(F.col("hub").isNotNull(), F.format_string("Most connected is %s with %d edges.", "hub", "hub_degree")),
        F.when(F.col("isolated_node_count") > 0, F.format_string("%d nodes have no edges.", "isolated_node_count")),
        F.when(F.col("community_count") > 1, F.format_string("There are %d communities.", "community_count")),
    ]
    return x.select(F.posexplode(F.array(*lines)).alias("ord", "insight")).where("insight is not null")


def insights(g: PropertyGraph) -> DataFrame:
    """(ord, insight): sentences about the graph."""
    return sentences(statistics(g, isolated_at=0), top_degree(g, 1))


def mean_weight(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship").agg(rounded(F.avg("weight"), 4).alias("mean_weight"))


def analyze(g: PropertyGraph, n: int = 10) -> dict[str, DataFrame]:
    """Statistics (isolated: no edge at all), top nodes, nodes by type, edges by relationship and confidence, insights."""
    return {
        "statistics": statistics(g, isolated_at=0),
        "top_nodes": top_degree(g, n),
        "nodes_by_type": histogram(g.nodes, "type"),
        "edges_by_relationship": histogram(g.edges, "relationship"),
        "edges_by_confidence": histogram(g.edges.select(confidence_name(F.col("confidence_ord")).alias("confidence")), "confidence"),
        "mean_weight": mean_weight(g.edges),
        "insights": insights(g),
    }
