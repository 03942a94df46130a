"""God nodes, surprising connections, bridges and questions worth asking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_concept, is_file_label, path_category, top_dir
from ..model import AMBIGUOUS, EDGE_KEY, INFERRED, PropertyGraph, confidence_name, keep
from .metrics import inferred_counts, joined, with_degree

#: Relationships that say how code is laid out rather than what it does.
STRUCTURAL = ("imports", "imports_from", "contains", "method")


def god_nodes(g: PropertyGraph, n: int = 10) -> DataFrame:
    """The n nodes of the highest degree that are neither files nor concepts."""
    x = with_degree(g).where(~is_file_label(F.col("label")) & ~is_concept(F.col("file_path")))
    return x.select("id", "label", F.col("degree").alias("edge_count")).orderBy(F.desc("edge_count"), "id").limit(n)


def surprise_scores(g: PropertyGraph) -> DataFrame:
    """(src, dst, relationship, confidence, score, why) of edges between entities of different files."""
    path = F.col("file_path")
    named = _entity(with_degree(g)).withColumns({"category": path_category(path), "top": top_dir(path)})  # once for each node, not each edge
    x = joined(PropertyGraph(named, g.edges), "file_path", "community", "degree", "category", "top").where(~F.col("relationship").isin(*STRUCTURAL))
    x = x.where("src_file_path <> dst_file_path")
    a, b = F.col("src_category"), F.col("dst_category")
    ord_ = F.col("confidence_ord")
    low, high = F.least("src_degree", "dst_degree"), F.greatest("src_degree", "dst_degree")
    trust = F.when(ord_ == AMBIGUOUS, 3).when(ord_ == INFERRED, 2).otherwise(1)
    signs = [(a != b, 2, F.concat(F.lit("crosses file types ("), a, F.lit(" to "), b, F.lit(")"))), (F.col("src_top") != F.col("dst_top"), 2, F.lit("connects different directories")), (F.coalesce(F.col("src_community") != F.col("dst_community"), F.lit(False)), 1, F.lit("bridges communities")), ((low <= 2) & (high >= 5), 1, F.lit("peripheral node reaches a hub"))]
    score, why = trust, [F.when(ord_ != 0, F.concat(F.lower(confidence_name(ord_)), F.lit(" connection")))]
    for test, points, text in signs:
        score = score + F.when(test, points).otherwise(0)
        why.append(F.when(test, text))
    reasons = F.concat_ws("; ", *why)
    return x.select("src", "dst", "relationship", confidence_name(ord_).alias("confidence"), score.cast("int").alias("score"), F.when(reasons == "", "cross-file semantic connection").otherwise(reasons).alias("why"))


def cross_file_surprises(g: PropertyGraph, n: int = 5) -> DataFrame:
    return surprise_scores(g).orderBy(F.desc("score"), *EDGE_KEY).limit(n)


def bridges(g: PropertyGraph, n: int = 5) -> DataFrame:
    """The first edge of each pair of communities, ambiguous before inferred before extracted, n of them."""
    x = g.sided({"community": F.col("community"), "named": ~is_file_label(F.col("label"))}).where(~F.col("relationship").isin(*STRUCTURAL))
    x = x.where("src_community <> dst_community and src_named and dst_named")
    low, high = F.least("src_community", "dst_community").alias("low"), F.greatest("src_community", "dst_community").alias("high")
    first = x.select(low, high, *EDGE_KEY, "confidence_ord").groupBy("low", "high").agg(F.min(F.struct(*EDGE_KEY, "confidence_ord")).alias("e"))
    out = first.select("low", "high", "e.*")
    return out.orderBy(F.desc("confidence_ord"), *EDGE_KEY).limit(n).select("low", "high", *EDGE_KEY, confidence_name(F.col("confidence_ord")).alias("confidence"))


def surprises(g: PropertyGraph, n: int = 5) -> DataFrame:
    """Across files where there are several, else across communities: (src, dst, relationship, confidence, why)."""
    files = g.nodes.where("file_path <> ''").select("file_path").distinct().limit(2).count()
    if files > 1:
        return cross_file_surprises(g, n).select(*EDGE_KEY, "confidence", "why")
    return bridges(g, n).select(*EDGE_KEY, "confidence", F.format_string("bridges communities %d and %d", "low", "high").alias("why"))


def entity() -> Column:
    """Whether a node is neither a file nor a concept."""
    return ~is_file_label(F.col("label")) & ~is_concept(F.col("file_path"))


def _entity(nodes: DataFrame) -> DataFrame:
    return nodes.where(entity())


def bridge_nodes(g: PropertyGraph, n: int = 3) -> DataFrame:
    """(id, label, others): entities whose out-neighbours lie in two or more other communities; the n first by id."""
    x = g.sided({"community": F.col("community"), "entity": entity()}).where("src_entity and src_community <> dst_community")
    x = x.select(F.col("src").alias("id"), F.col("dst_community").alias("far")).distinct()
    x = x.groupBy("id").agg(F.sort_array(F.collect_list("far")).alias("others")).where(F.size("others") >= 2)
    return g.nodes.select("id", "label").join(F.broadcast(x.orderBy("id").limit(n)), "id").orderBy("id")


def inferred_examples(g: PropertyGraph, n: int = 3, examples: int = 2) -> DataFrame:
    """(id, inferred, rank, other): the n entities with the most inferred edges (two at least), with neighbours by id."""
    top = inferred_counts(g).where("inferred >= 2").join(g.nodes.where(~is_file_label(F.col("label"))).select("id"), "id").orderBy(F.desc("inferred"), "id").limit(n)
    e = g.edges.where(F.col("confidence_ord") == INFERRED)
    both = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))
    near = e.select(F.inline(both)).join(F.broadcast(top), "id").distinct()
    rank = F.row_number().over(Window.partitionBy("id").orderBy("other"))
    return near.withColumn("rank", rank).where(F.col("rank") <= examples).select("id", "inferred", "rank", "other")


def isolated(g: PropertyGraph, at: int = 1) -> DataFrame:
    """(id, label, degree) of entities with at most so many edges."""
    return with_degree(_sub(g)).where(F.col("degree") <= at).select("id", "label", "degree")


def _sub(g: PropertyGraph) -> PropertyGraph:
    return PropertyGraph(_entity(g.nodes), g.edges, g.unique)  # sides go by all nodes


def questions(g: PropertyGraph, n: int = 10) -> DataFrame:
    """(section, ord, kind, question, why): at most n, by kind; one no_signal row if there are none.

    The edges are written once for all kinds, and the questions before it is seen whether there are any.
    """
    g = g.settled(community=F.col("community"), entity=entity())
    label = lambda df, c: df.join(g.nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")), c)
    first = g.edges.where(F.col("confidence_ord") == AMBIGUOUS).orderBy(*EDGE_KEY).limit(n)

    def rows(df: DataFrame, section: int, kind: str, ord_: Column, question: Column, why: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), ord_.alias("ord"), F.lit(kind).alias("kind"), question.alias("question"), why.alias("why"))

    key = F.concat_ws("|", *EDGE_KEY)
    unsure = rows(label(label(first, "src"), "dst"), 0, "ambiguous_edge", key, F.format_string("What is the exact relationship between `%s` and `%s`?", "src_label", "dst_label"), F.format_string("Edge tagged AMBIGUOUS (relation: %s)", "relationship"))
    bridge = rows(bridge_nodes(g), 1, "bridge_node", F.col("id"), F.format_string("Why does `%s` connect so many communities?", "label"), F.concat(F.lit("Reaches communities "), F.array_join(F.col("others").cast("array<string>"), ", ")))
    checked = inferred_examples(g).groupBy("id", "inferred").agg(F.array_join(F.sort_array(F.collect_list("other")), ", ").alias("examples"))
    verify = rows(checked, 2, "verify_inferred", F.concat(F.lpad((F.lit(10**9) - F.col("inferred")).cast("string"), 10, "0"), "id"), F.format_string("Are the %d inferred relationships of `%s` right?", "inferred", "id"), F.concat(F.lit("For example with "), "examples"))
    alone = keep(isolated(g).select("id"))
    some = alone.orderBy("id").limit(3).agg(F.array_join(F.sort_array(F.collect_list("id")), ", ").alias("some"))
    alone = rows(alone.agg(F.count("*").alias("n")).where("n > 0").join(some), 3, "isolated_nodes", F.lit(""), F.format_string("What connects %s to the rest?", "some"), F.format_string("%d nodes have at most one edge", "n"))
    found = keep(unsure.unionByName(bridge).unionByName(verify).unionByName(alone).orderBy("section", "ord").limit(n))
    none = g.edges.sparkSession.range(1).select(F.lit(9).alias("section"), F.lit("").alias("ord"), F.lit("no_signal").alias("kind"), F.lit(None).cast("string").alias("question"), F.lit("Not enough signal to ask a question").alias("why"))
    fallback = none.join(found.limit(1).select(F.lit(1).alias("x")), how="left_anti", on=F.lit(True))
    return found.unionByName(fallback).orderBy("section", "ord").limit(n)
