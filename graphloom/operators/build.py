"""From extracted rows to a graph: merge nodes and edges, add file nodes, drop weak and dangling edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, normal_path
from ..model import EDGE_KEY, EXTRACTED, PropertyGraph, existing

#: The node type of each file type.
TYPES = {"Code": "Entity", "Document": "Document", "Paper": "Paper", "Image": "Image"}


def node_type(file_type: Column, metadata: Column) -> Column:
    """The metadata's type, else by file type."""
    out = F.lit("Unknown")
    for k, v in TYPES.items():
        out = F.when(file_type == k, v).otherwise(out)
    return F.coalesce(F.try_element_at(metadata, F.lit("type")), out)


def relative_paths(extractions: DataFrame) -> DataFrame:
    """(path_key, relative_path): the last mapping of each source path, compared without case."""
    rows = extractions.where("relative_path is not null").select(F.lower("source_file").alias("path_key"), "relative_path", "ord")
    return rows.groupBy("path_key").agg(F.max_by("relative_path", F.struct("ord", "relative_path")).alias("relative_path"))


def merge_nodes(extracted: DataFrame, paths: DataFrame | None = None, strategy: str = "last", tasks: int = 0) -> DataFrame:
    """One node for each id of (id, label, file_type, source_file, source_location, metadata, ord).

    The last row by ord gives label, type and path. strategy "aggregate" folds all rows' metadata, later keys over
    earlier ones; any other keeps the last row's. source_location and, above one, merge_count are added. tasks: to how many tasks a fold deals the rows, where they are
    too many for the session's.
    """
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    order = F.struct("ord", "source_file", "label", "source_location", "file_type")
    last = F.max_by(F.struct("label", "file_type", "source_file", "source_location", *([] if strategy == "aggregate" else [own.alias("metadata")])), order).alias("last")
    # One exchange of the rows serves both of a fold's groupings and their join.
    if strategy == "aggregate":
        extracted = extracted.repartition(tasks, "id") if tasks else extracted.repartition("id")
    merged = extracted.groupBy("id").agg(last, F.count("*").alias("n"))
    if strategy == "aggregate":
        entries = extracted.select("id", order.alias("o"), F.explode(own)).groupBy("id", "key").agg(F.max_by("value", F.struct("o", "value")).alias("value"))
        folded = entries.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("folded"))
        merged = merged.join(folded, "id", "left").withColumn("metadata", F.coalesce("folded", F.create_map().cast("map<string,string>")))
    else:
        merged = merged.withColumn("metadata", F.col("last.metadata"))
    extra = F.filter(F.array(F.struct(F.lit("source_location").alias("key"), F.col("last.source_location").alias("value")), F.struct(F.lit("merge_count").alias("key"), F.when(F.col("n") > 1, F.col("n").cast("string")).alias("value"))), lambda e: e["value"].isNotNull())
    path = normal_path(F.col("last.source_file"))
    out = merged.select("id", F.col("last.label").alias("label"), node_type(F.col("last.file_type"), F.col("metadata")).alias("type"), path.alias("file_path"), F.lit(EXTRACTED).cast("tinyint").alias("confidence_ord"), _over(F.col("metadata"), F.map_from_entries(extra)).alias("metadata"), F.lower("last.source_file").alias("path_key"))
    if paths is None:
        return out.drop("path_key").withColumn("relative_path", F.lit(None).cast("string"))
    return out.join(paths, "path_key", "left").drop("path_key").withColumn("relative_path", normal_path(F.col("relative_path")))


def _over(a: Column, b: Column) -> Column:
    """Map a with b's entries over it, whatever the session does with equal keys."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def merge_edges(raw: DataFrame, nodes: DataFrame | None = None, min_weight: float = 0.0) -> DataFrame:
    """One edge for each (src, dst, relationship): summed weight, highest confidence, count, first source by ord.

    Edges whose ends aren't in nodes are left out (after the merge, when there are fewer), and those lighter than min_weight.
    """
    out = merged(raw, EDGE_KEY).where(F.col("weight") >= min_weight)
    if nodes is not None:
        out = existing(out, nodes)
    return with_source(out)


def merged(raw: DataFrame, key: list[str]) -> DataFrame:
    """(*key, weight, confidence_ord, merge_count, source_file): one row for each key, as merge_edges() has them."""
    return raw.groupBy(*key).agg(F.sum("weight").alias("weight"), F.min("confidence_ord").alias("confidence_ord"), F.count("*").alias("merge_count"), F.min(F.struct("ord", "source_file")).getField("source_file").alias("source_file"))


def with_source(edges: DataFrame) -> DataFrame:
    """Merged edges with count and first source as metadata."""
    return edges.withColumn("metadata", F.create_map(F.lit("merge_count"), F.col("merge_count").cast("string"), F.lit("source_file"), F.coalesce("source_file", F.lit(""))))


def file_nodes(sources: DataFrame) -> DataFrame:
    """A File node for each distinct non-blank source_file."""
    path = normal_path(F.col("source_file"))
    files = sources.where(F.trim("source_file") != "").select(path.alias("file_path")).distinct()
    return files.select(F.concat(F.lit("file:"), "file_path").alias("id"), file_name(F.col("file_path")).alias("label"), F.lit("File").alias("type"), "file_path", F.lit(EXTRACTED).cast("tinyint").alias("confidence_ord"), F.create_map(F.lit("full_path"), "file_path").alias("metadata"))


def contains_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """A contains edge from each file to each of its nodes (source_file, id) that edges lack."""
    path = normal_path(F.col("source_file"))
    own = members.where(F.trim("source_file") != "").select(F.concat(F.lit("file:"), path).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("relationship")).distinct()
    fresh = own.join(edges.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return fresh.select(*EDGE_KEY, F.lit(1.0).alias("weight"), F.lit(EXTRACTED).cast("tinyint").alias("confidence_ord"), F.create_map(F.lit("merge_count"), F.lit("1")).alias("metadata"))


def build(extracted_nodes: DataFrame, extracted_edges: DataFrame, paths: DataFrame | None = None, with_files: bool = True, min_weight: float = 0.0, strategy: str = "last") -> PropertyGraph:
    """The graph of extracted rows. Contains edges follow the weight limit like all others."""
    nodes = merge_nodes(extracted_nodes, paths, strategy)
    if with_files:
        nodes = nodes.unionByName(file_nodes(extracted_nodes), allowMissingColumns=True)
    edges = merge_edges(extracted_edges, nodes)
    if with_files:
        edges = edges.unionByName(contains_edges(extracted_nodes, edges), allowMissingColumns=True)
    return PropertyGraph.of(nodes, edges.where(F.col("weight") >= min_weight))
