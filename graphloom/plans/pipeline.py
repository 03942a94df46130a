"""From a folder of sources to a clustered graph and its renderings: python -m graphloom.plans.pipeline run PATH."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..operators.build import build
from ..operators.cluster import cluster, detect
from ..operators.extract import extract
from ..operators.traverse import cost_summary, retrieval_cost
from ..sources import semantic
from ..sources.files import CODE, LANGUAGES, detect_files, read_graph, texts, tracked_files
from ..sources.listing import folder_changes
from ..sources.sinks import export, summary_lines
from ..streaming.incremental import Cache, Maintainer


def build_graph(spark: SparkSession, root: str, min_weight: float = 0.1, git: bool = False, chat: Callable[[str], str] | None = None, cache: Cache | None = None) -> PropertyGraph:
    """The graph of the files below root. chat: a model that is asked about each file beside the rules; its answers are kept in cache."""
    files = detect_files(spark, root, tracked=tracked_files(root) if git else None)
    found = extract(texts(files))
    if chat is not None:
        answered = semantic.answers(files, chat, cache=cache)
        for r in answered.where("reason is not null").select("path", "reason").orderBy("path").limit(20).collect():
            print(f"{r.path}: {r.reason}")
        found = semantic.both(found, semantic.extraction(answered))
    return build(*found, min_weight=min_weight)


def render(g: PropertyGraph, out: str, formats: tuple[str, ...], verbose: bool = False) -> dict[str, str]:
    failed = export(g, out, formats)
    for name, why in failed.items():
        print(f"{name}: {why}")
    if verbose:
        print("\n".join(summary_lines(g)))
    return failed


def run(spark: SparkSession, root: str, out: str, formats: tuple[str, ...] = ("json", "html", "report"), min_weight: float = 0.1, git: bool = False, chat: Callable[[str], str] | None = None, cached: bool = True, verbose: bool = True) -> tuple[PropertyGraph, dict[str, str]]:
    """The clustered graph of root, written to out, and what formats failed. cached: answers of chat are kept in out/answers."""
    cache = Cache(spark, f"{out}/answers") if chat is not None and cached else None
    g = cluster(build_graph(spark, root, min_weight, git, chat, cache).lasting()).lasting()
    return g, render(g, out, formats, verbose)


def named(name: str) -> Callable[[str], str]:
    """The function package.module:function."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def extract_changes(rows: DataFrame) -> PropertyGraph:
    """The graph of changed rows (path, content); the path's extension says the language."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    nodes, edges = extract(rows.withColumn("language", names[ext]))
    return build(nodes, edges, min_weight=0.0)


def watch(spark: SparkSession, root: str, out: str, formats: tuple[str, ...] = ("json", "html", "report"), every: float = 0.5, ticks: int | None = None) -> Maintainer:
    """Follow the code files below root as a stream; each change brings the graph in out/state up to date, clusters and exports.

    A look lists the folder and opens only files whose size or time has changed. Nodes of deleted files go. After a
    restart it goes on from the state in the folder. ticks: stop after so many looks.
    """
    keeper = Maintainer(spark, f"{out}/state", extract_changes, detect, delete=True)
    events = folder_changes(spark, root, f"{out}/state/listings", CODE, every)

    def apply(rows: DataFrame, batch: int) -> None:
        if rows.limit(1).count():
            keeper.apply(rows, batch)
            render(keeper.load(), out, formats)

    keeper.stream = f"{out}/state/stream"
    query = events.writeStream.foreachBatch(apply).option("checkpointLocation", keeper.stream).trigger(processingTime=f"{every} seconds").start()
    try:
        if ticks is None:
            query.awaitTermination()
        for _ in range(ticks or 0):
            query.processAllAvailable()
    finally:
        query.stop()
    return keeper


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("command", choices=["run", "watch", "benchmark"])
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-o", "--output", default="graph-out")
    p.add_argument("-f", "--formats", default="json,html,report")
    p.add_argument("-w", "--min-weight", type=float, default=0.1)
    p.add_argument("-e", "--every", type=float, default=0.5, help="seconds between looks of watch")
    p.add_argument("--git", action="store_true", help="only files that git tracks")
    p.add_argument("--chat", help="package.module:function that answers a prompt; it is asked about each file")
    p.add_argument("--no-cache", action="store_true", help="ask again what was answered before")
    p.add_argument("-v", "--verbose", action="store_true", help="show what the graph has")
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    formats = tuple(x.strip().lower() for x in a.formats.split(",") if x.strip())
    if a.command == "run":
        _, failed = run(spark, a.path, a.output, formats, a.min_weight, a.git, named(a.chat) if a.chat else None, not a.no_cache, a.verbose)
        if failed:
            sys.exit(1)
    elif a.command == "watch":
        watch(spark, a.path, a.output, formats, a.every)
    else:
        costs = retrieval_cost(read_graph(spark, a.path))
        costs.show(truncate=55)
        cost_summary(costs).show()


if __name__ == "__main__":
    main()
