"""Degrees, histograms, modularity, cohesion and other structural measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import percent, rounded
from ..model import AMBIGUOUS, EDGE_KEY, EXTRACTED, INFERRED, PropertyGraph, confidence_name, ends


def degrees(g: PropertyGraph) -> DataFrame:
    """(id, degree): in plus out, a self loop twice, 0 for nodes without edges. Counts are partial before the shuffle."""
    return with_degree(g).select("id", "degree")


def with_degree(g: PropertyGraph) -> DataFrame:
    """Nodes with their degree, by one join."""
    hits = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return g.nodes.join(hits, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def top_degree(g: PropertyGraph, n: int = 10) -> DataFrame:
    """The n nodes of the highest degree, ties by id; files and concepts too."""
    return with_degree(g).select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(n)


def average_degree(total: Column, nodes: Column) -> Column:
    return F.when(nodes > 0, rounded(total / nodes)).otherwise(0.0)


def statistics(g: PropertyGraph, isolated_at: int = 1) -> DataFrame:
    """One row; a node is isolated if its degree is at most isolated_at."""
    per = with_degree(g).agg(F.count("*").alias("node_count"), F.countDistinct("community").alias("community_count"), F.coalesce(F.sum("degree"), F.lit(0)).alias("total"), F.count_if(F.col("degree") <= isolated_at).alias("isolated_node_count"))
    edges = g.edges.agg(F.count("*").alias("edge_count"))
    average = average_degree(F.col("total"), F.col("node_count"))
    return per.join(edges).select("node_count", "edge_count", "community_count", average.alias("average_degree"), "isolated_node_count")


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def confidence_summary(g: PropertyGraph) -> DataFrame:
    """One row: edges of each confidence, their percentages, and the average weight of inferred ones."""
    is_ = lambda k: F.col("confidence_ord") == k
    out = g.edges.agg(F.count("*").alias("edges"), *[F.count_if(is_(k)).alias(n) for n, k in (("extracted", EXTRACTED), ("inferred", INFERRED), ("ambiguous", AMBIGUOUS))], F.avg(F.when(is_(INFERRED), F.col("weight"))).alias("mean"))
    share = [percent(F.col(n), F.col("edges")).alias(f"{n}_percent") for n in ("extracted", "inferred", "ambiguous")]
    return out.select("edges", "extracted", "inferred", "ambiguous", *share, rounded(F.coalesce("mean", F.lit(0.0))).alias("mean_inferred_weight"))


def communities(g: PropertyGraph) -> DataFrame:
    """(community, size, first_id), nodes without one left out."""
    return g.nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("size"), F.min("id").alias("first_id"))


def community_labels(g: PropertyGraph) -> DataFrame:
    """(community, label): the most frequent type, of equally frequent ones the first by name."""
    n = g.nodes.where("community is not null").groupBy("community", "type").agg(F.count("*").alias("n"))
    best = n.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("best"))
    return best.select("community", F.format_string("%s (Community %d)", "best.type", "community").alias("label"))


def joined(g: PropertyGraph, *attributes: str) -> DataFrame:
    """Edges with attributes of both ends as src_x and dst_x."""
    return g.sided({a: F.col(a) for a in attributes})


def community_links(g: PropertyGraph, distinct: bool = False) -> DataFrame:
    """(src_community, dst_community, confidence_ord, way, n): edges between communities; way is 0 for loops, 1 where src < dst, else 2.

    An end that is in no community counts as null. distinct: edges equal by key count once, whatever their confidence.
    """
    if g.closed:
        x = joined(g, "community")
    else:
        side = lambda end: g.nodes.select(F.col("id").alias(end), F.col("community").alias(f"{end}_community"))
        x = g.edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    x = x if g.unique or not distinct else x.dropDuplicates(EDGE_KEY)
    way = F.when(F.col("src") == F.col("dst"), 0).when(F.col("src") < F.col("dst"), 1).otherwise(2)
    return x.groupBy("src_community", "dst_community", "confidence_ord", way.alias("way")).agg(F.count("*").alias("n"))


def audit_trail(g: PropertyGraph, links: DataFrame | None = None) -> DataFrame:
    """(community, confidence, n): edges counted once for each end in the community, an inner one twice. links: community_links(g), if known."""
    links = community_links(g) if links is None else links
    hits = links.select(F.explode(F.array("src_community", "dst_community")).alias("community"), "confidence_ord", "n").where("community is not null")
    return hits.groupBy("community", "confidence_ord").agg(F.sum("n").alias("n")).select("community", confidence_name(F.col("confidence_ord")).alias("confidence"), "n")


def cross_links(g: PropertyGraph, n: int = 12, links: DataFrame | None = None) -> DataFrame:
    """(community, other, links, rank): out-edges into other communities, the n largest for each. links: community_links(g), if known."""
    links = community_links(g) if links is None else links
    links = links.where("src_community <> dst_community").groupBy(F.col("src_community").alias("community"), F.col("dst_community").alias("other")).agg(F.sum("n").alias("links"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("links"), "other"))
    return links.withColumn("rank", rank).where(F.col("rank") <= n)


def adjacency(g: PropertyGraph) -> DataFrame:
    """(id, other, weight): undirected, parallel edges summed, a self loop once."""
    return ends(g.distinct_edges(), "weight").groupBy("id", "other").agg(F.sum("weight").alias("weight"))


def modularity(g: PropertyGraph) -> DataFrame:
    """One row: sum over communities of in/W - (deg/2W)^2; nodes without a community don't count, nor does half of a self loop."""
    total = g.edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    own = g.nodes.where("community is not null").select("id", "community")
    x = g.distinct_edges().select("src", "dst", "weight")
    for end in ("src", "dst"):
        x = x.join(own.toDF(end, f"{end}_community"), end, "left")
    side = lambda a, b: F.struct(F.col(f"{a}_community").alias("community"), F.col(f"{b}_community").alias("far"), "weight")
    x = x.select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(side("src", "dst"))).otherwise(F.array(side("src", "dst"), side("dst", "src"))))).where("community is not null")
    per = x.groupBy("community").agg((F.sum(F.when(F.col("community") == F.col("far"), F.col("weight")).otherwise(0.0)) / 2).alias("inner"), F.sum("weight").alias("deg"))
    q = per.join(total).where("w > 0").agg(F.sum(F.col("inner") / F.col("w") - F.pow(F.col("deg") / (2 * F.col("w")), F.lit(2.0))).alias("q"))
    return q.select(rounded(F.coalesce("q", F.lit(0.0)), 6).alias("modularity"))


def _inner(g: PropertyGraph, per_edge: Column, links: DataFrame | None = None) -> DataFrame:
    """Communities with hits: per_edge, by way, over the distinct edges inside."""
    links = community_links(g, distinct=True) if links is None else links
    hits = links.where("src_community = dst_community").groupBy(F.col("src_community").alias("community")).agg(F.sum(per_edge * F.col("n")).alias("hits"))
    return communities(g).join(hits, "community", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def cohesion_engine(g: PropertyGraph) -> DataFrame:
    """(community, cohesion): twice the inner edges with src < dst over the pairs, 1 for single nodes; may exceed 1."""
    n = F.col("size")
    value = F.when(n <= 1, 1.0).otherwise(rounded(F.col("hits") / (n * (n - 1) / 2)))
    return _inner(g, F.when(F.col("way") == 1, 2).otherwise(0)).select("community", value.alias("cohesion"))


def cohesion_report(g: PropertyGraph, links: DataFrame | None = None) -> DataFrame:
    """(community, cohesion): inner edges seen from both ends over ordered pairs, 0 for single nodes. links: community_links(g, True), if known."""
    n = F.col("size")
    value = F.when(n < 2, 0.0).otherwise(rounded(F.col("hits") / (n * (n - 1))))
    return _inner(g, F.when(F.col("way") == 0, 1).otherwise(2), links).select("community", value.alias("cohesion"))


def density(g: PropertyGraph) -> DataFrame:
    """(community, density): distinct unordered inner pairs over all pairs, at most 1."""
    x = joined(g, "community").where("src_community = dst_community and src <> dst")
    pairs = x.select(F.col("src_community").alias("community"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().groupBy("community").agg(F.count("*").alias("pairs"))
    n = F.col("size")
    value = F.when(n < 2, 0.0).otherwise(rounded(F.coalesce("pairs", F.lit(0)) / (n * (n - 1) / 2), 6))
    return communities(g).join(pairs, "community", "left").select("community", value.alias("density"))


def inferred_counts(g: PropertyGraph) -> DataFrame:
    """(id, inferred): inferred edges in or out, distinct by key, a self loop once."""
    e = g.edges.where(F.col("confidence_ord") == INFERRED)
    e = e if g.unique else e.dropDuplicates(EDGE_KEY)
    both = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    return e.select(F.explode(both).alias("id")).groupBy("id").agg(F.count("*").alias("inferred"))


def top_members(g: PropertyGraph, n: int = 5) -> DataFrame:
    """(community, rank, id, degree, more): the n members of the highest degree, and how many more there are."""
    w = Window.partitionBy("community")
    x = with_degree(g).where("community is not null").select("community", "id", "degree")
    x = x.withColumn("rank", F.row_number().over(w.orderBy(F.desc("degree"), "id"))).join(communities(g).select("community", "size"), "community")
    return x.where(F.col("rank") <= n).select("community", "rank", "id", "degree", F.greatest(F.col("size") - n, F.lit(0)).alias("more"))
