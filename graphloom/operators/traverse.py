"""Shortest paths, neighbourhoods and what a question costs to answer from the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import rounded
from ..model import PropertyGraph, existing, keep

#: Nodes of a frontier that are sent to the edges, which then aren't shuffled; hops of a path before its edges are written once for all further ones.
BROADCAST, LAZY = 1 << 16, 4
#: The questions asked when none are given.
QUESTIONS = ("how does authentication work", "what is the main entry point", "how are errors handled", "what connects the data layer to the api", "what are the core abstractions")


def shortest_path(g: PropertyGraph, source: str, target: str, max_hops: int | None = None) -> DataFrame:
    """(step, id, label) along a shortest path over out-edges; no rows if there is none or an end doesn't exist.

    The search goes on until the target is met or nothing new is. max_hops: where that many hops don't settle it,
    ValueError; "no path" is never an answer to a search cut short.
    """
    edges = g.closed_edges().select("src", "dst").where("src <> dst")
    kept: list[DataFrame] = []

    def hop(frontier: DataFrame, n: int, k: int) -> DataFrame:
        if n <= BROADCAST and k <= LAZY:
            return edges.join(F.broadcast(frontier.select(F.col("id").alias("src"))), "src", "left_semi").select("src", "dst")
        if not kept:
            kept.append(keep(edges.distinct()))
        return kept[0].join(frontier.select(F.col("id").alias("src")), "src").select("src", "dst")

    return path(g.nodes.select("id", "label"), hop, source, target, max_hops)


def path(nodes: DataFrame, hop: Callable[[DataFrame, int, int], DataFrame], source: str, target: str, max_hops: int | None = None) -> DataFrame:
    """shortest_path() over nodes (id, label) and hop: the edges (src, dst) out of a frontier (id) of so many nodes, for which hop this is.

    Each round takes the edges out of the frontier and drops what was seen; among equal parents the smallest id stays.
    Each round's nodes are checkpointed, and every few rounds all seen ones, so that the plan doesn't grow with the
    path. The way back is read off the rounds, a few at a time.
    """
    spark = nodes.sparkSession
    known = nodes.where(F.col("id").isin(source, target)).select("id").distinct().count()
    empty = nodes.select(F.lit(0).alias("step"), "id", "label").limit(0)
    if known != len({source, target}):
        return empty
    seen = spark.createDataFrame([(source, None, 0)], "id string, parent string, hop int")
    rounds, k, found, n = [seen], 0, source == target, 1
    while not found:
        if max_hops is not None and k == max_hops:
            raise ValueError(f"no path of up to {max_hops} hops; there may be a longer one")
        k += 1
        step = hop(rounds[-1].select("id"), n, k).groupBy("dst").agg(F.min("src").alias("parent"))
        step = keep(step.select(F.col("dst").alias("id"), "parent", F.lit(k).alias("hop")).join(seen.select("id"), "id", "left_anti"))
        met = step.agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("id") == target), F.lit(False)).alias("found")).first()
        if not met.n:
            return empty
        seen = seen.unionByName(step)
        seen = keep(seen) if k % 8 == 0 else seen
        rounds.append(step)
        found, n = met.found, met.n
    steps, at = [], spark.createDataFrame([(target,)], "id string")
    for n in range(k, -1, -8):  # so many rounds are joined at a time
        chain = [at.select(F.col("id").alias(f"x{n}"))]
        for i in range(n, max(n - 8, -1), -1):
            up = rounds[i].select(F.col("id").alias(f"x{i}"), F.col("parent").alias(f"x{i - 1}"))
            chain.append(F.broadcast(chain[-1]).join(up, f"x{i}"))  # one row
        row = chain[-1].first()
        steps += [(i, row[f"x{i}"]) for i in range(n, max(n - 8, -1), -1)]
        at = spark.createDataFrame([(row[f"x{max(n - 8, -1)}"],)], "id string")
    return spark.createDataFrame(sorted(steps), "step int, id string").join(nodes, "id").select("step", "id", "label")


def expand(g: PropertyGraph, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(id, hop) of nodes within so many out-edges of seeds (id), at their first hop."""
    edges = g.closed_edges().select("src", "dst")
    seen = frontier = keep(seeds.select("id", F.lit(0).alias("hop")))
    for hop in range(1, hops + 1):
        if not (n := frontier.count()):
            break
        ids = frontier.select(F.col("id").alias("src"))
        step = edges.join(F.broadcast(ids) if n <= BROADCAST else ids, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = keep(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop")))
        seen = seen.unionByName(frontier)
    return seen


def between(g: PropertyGraph, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids (id), distinct by key."""
    return existing(g.distinct_edges(), ids)


def terms(question: str) -> list[str]:
    return [t for t in question.lower().split(" ") if len(t) > 2]


def seeds(g: PropertyGraph, question: str, n: int = 3) -> DataFrame:
    """(id, score): nodes whose label has most of the question's words, n of them, ties by id."""
    words = F.array(*map(F.lit, terms(question))) if terms(question) else F.array().cast("array<string>")
    score = F.size(F.filter(words, lambda t: F.contains(F.lower("label"), t)))
    return g.nodes.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(n)


def retrieval_cost(g: PropertyGraph, questions: tuple[str, ...] = QUESTIONS, corpus_words: int | None = None, hops: int = 3) -> DataFrame:
    """(question, query_tokens, corpus_tokens, reduction) of questions that find anything; 4 characters are a token."""
    nodes = g.nodes.count()
    corpus = (corpus_words if corpus_words is not None else 50 * nodes) * 100 // 75
    out = None
    for q in questions:
        near = expand(g, seeds(g, q).select("id"), hops).select("id")
        line = F.concat(F.lit("NODE "), "label", F.lit(" src="), F.coalesce("file_path", F.lit("")), F.lit(" loc="), F.coalesce(F.try_element_at("metadata", F.lit("source_location")), F.lit("")))
        a = g.nodes.join(near, "id").select(F.length(line).alias("n"))
        e = between(g, near).join(g.nodes.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(g.nodes.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
        b = e.select(F.length(F.concat(F.lit("EDGE "), "a", F.lit(" --"), "relationship", F.lit("--> "), "b")).alias("n"))
        total = a.unionByName(b).agg(F.sum(F.col("n") + 1).alias("n")).where("n is not null")
        tokens = F.greatest(F.lit(1), F.expr("n div 4")).cast("long")
        row = total.select(F.lit(q).alias("question"), tokens.alias("query_tokens"), F.lit(corpus).cast("long").alias("corpus_tokens"), rounded(F.lit(float(corpus)) / tokens, 1).alias("reduction"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no questions")
    return out


def cost_summary(costs: DataFrame) -> DataFrame:
    """One row over the questions: (questions, corpus_tokens, avg_query_tokens, reduction)."""
    avg = F.avg("query_tokens").cast("long")
    return costs.agg(F.count("*").alias("questions"), F.max("corpus_tokens").alias("corpus_tokens"), avg.alias("avg_query_tokens")).where("questions > 0").select("*", rounded(F.col("corpus_tokens") / F.col("avg_query_tokens"), 1).alias("reduction"))
