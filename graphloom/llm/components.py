"""Connected components over an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, c) for every endpoint of edges (a, b): c is the smallest vertex that v reaches.

    In a round every vertex points to the first, in a random order of the round, of itself and its neighbours, and then
    to what that one points to; edges are drawn anew between what their ends point to, and those within one vertex go.
    In a random order pointers are short, so few vertices are pointed to, and rows shrink by a constant factor a round:
    all rounds together cost a few times the first. At the end the rounds' pointers are followed one after the other.
    Each round is written to the shared folder. Every shuffle is on a vertex, and hubs only ever meet partial minima or
    a splittable join. Null endpoints are ignored; a vertex that is only tied to itself is its own component.
    """
    e = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = materialize(e.distinct(), "edges")
    rounds: list[DataFrame] = []
    for k in range(max_rounds):
        place = lambda v: F.struct(F.xxhash64(v, F.lit(k)).alias("h"), F.col(v).alias("v"))  # noqa: B023, E731
        ends = now.select(F.col("a").alias("v"), place("b").alias("m")).unionByName(now.select(F.col("b").alias("v"), place("a").alias("m")))
        near = materialize(ends.groupBy("v").agg(F.min("m").alias("m")).select("v", F.least(place("v"), "m")["v"].alias("p")), "near")
        far = near.join(near.select(F.col("v").alias("p"), F.col("p").alias("c")), "p").select("v", "c")
        rounds.append(materialize(far, "round"))
        to = rounds[-1]
        drawn = now.where("a <> b").join(to.select(F.col("v").alias("a"), F.col("c").alias("x")), "a").join(to.select(F.col("v").alias("b"), F.col("c").alias("y")), "b")
        new = materialize(drawn.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(now, near)
        now = new
        if not now.limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    out = rounds[-1]
    for step in reversed(rounds[:-1]):
        out = step.join(out.select(F.col("v").alias("c"), F.col("c").alias("last")), "c", "left").select("v", F.coalesce("last", "c").alias("c"))
    out = materialize(out.withColumnRenamed("c", "r"), "roots")
    least = out.groupBy("r").agg(F.min("v").alias("c"))
    labels = materialize(out.join(least, "r").select("v", "c"), "labels")
    discard(now, out, *rounds)
    return labels
