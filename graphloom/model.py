"""The property graph: two DataFrames, and the order in which ties are broken."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Confidence names in order of trust; a smaller number is a higher confidence.
CONFIDENCE = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
EXTRACTED, INFERRED, AMBIGUOUS = range(3)

NODES = "id string, label string, type string, file_path string, relative_path string, language string, confidence_ord tinyint, community int, metadata map<string,string>"
EDGES = "src string, dst string, relationship string, weight double, confidence_ord tinyint, metadata map<string,string>"
EDGE_KEY = ["src", "dst", "relationship"]


def confidence_name(ord_col: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), ord_col.cast("int") + 1)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the schema's columns; those it lacks are null."""
    out = []
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes are unique by id; edges are directed and may be parallel. Ends that no node has are allowed until checked.

    unique: edges are known to be distinct on (src, dst, relationship); closed: their ends are known to be nodes.
    sides: how the source itself gives edges with attributes of both ends, see sided(). tasks: to how many tasks its edges
    are dealt, where the source knows it, so that what is dealt anew grows in tasks and not in size.
    """

    nodes: DataFrame
    edges: DataFrame
    unique: bool = False
    closed: bool = False
    sides: Callable[[dict[str, Column]], DataFrame] | None = None
    tasks: int = 0

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        return cls(conform(nodes, NODES), conform(edges, EDGES))

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    def cached(self) -> PropertyGraph:
        """Both frames persisted: every analysis reads them."""
        return PropertyGraph(self.nodes.persist(), self.edges.persist(), self.unique, self.closed)

    def lasting(self) -> PropertyGraph:
        """Both frames checkpointed where a checkpoint folder is set, so that plans start from them; else persisted."""
        return PropertyGraph(keep(self.nodes), keep(self.edges), self.unique, self.closed)

    def distinct_edges(self) -> DataFrame:
        """One edge for each (src, dst, relationship)."""
        return self.edges if self.unique else self.edges.dropDuplicates(EDGE_KEY)

    def closed_edges(self) -> DataFrame:
        """Edges whose ends are both nodes."""
        return self.edges if self.closed else existing(self.edges, self.nodes)

    def sided(self, want: dict[str, Column]) -> DataFrame:
        """Edges between nodes with want, by name columns of the nodes, of both ends as src_name and dst_name."""
        if self.sides is not None:
            return self.sides(want)
        side = lambda end: self.nodes.select(F.col("id").alias(end), *[c.alias(f"{end}_{n}") for n, c in want.items()])
        return self.edges.join(side("src"), "src").join(side("dst"), "dst")

    def settled(self, **want: Column) -> PropertyGraph:
        """A graph whose edges, with want of both ends, are written once for all that reads them; as it is where no source gives them."""
        if self.sides is None:
            return self
        own = [*EDGE_KEY, "weight", "confidence_ord"]
        x = cut(self.sides(want).select(*own, *[f"{end}_{n}" for n in want for end in ("src", "dst")]))
        sides = lambda some: x.select(*own, *[f"{end}_{n}" for n in some for end in ("src", "dst")])
        return PropertyGraph(self.nodes, x.select(*own), self.unique, self.closed, sides, self.tasks)

    def spread(self, df: DataFrame, *by: str) -> DataFrame:
        """df, which has about as many rows as the edges, dealt out by columns, to as many tasks as the edges at least."""
        return df.repartition(self.tasks, *by) if self.tasks else df.repartition(*by)

    # Container operations
    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def nodes_of(self, community: int) -> DataFrame:
        return self.nodes.where(F.col("community") == community)

    def out_neighbors(self, node_id: str) -> DataFrame:
        """One row for each out-edge, so parallel edges repeat a neighbour."""
        return self.edges.where(F.col("src") == node_id).select(F.col("dst").alias("id")).join(self.nodes, "id")

    def incident(self, node_id: str) -> DataFrame:
        """Edges in or out, distinct on (src, dst, relationship)."""
        return self.edges.where((F.col("src") == node_id) | (F.col("dst") == node_id)).dropDuplicates(EDGE_KEY)

    def add_edges(self, edges: DataFrame) -> PropertyGraph:
        """Edges whose ends both exist are added, parallel ones too; others are not."""
        return PropertyGraph(self.nodes, self.edges.unionByName(existing(conform(edges, EDGES), self.nodes)), closed=self.closed)

    def upsert_nodes(self, nodes: DataFrame) -> PropertyGraph:
        """New nodes replace those of the same id; a replaced node's edges are dropped."""
        new = conform(nodes, NODES)
        ids = new.select("id")
        kept = self.nodes.join(ids, "id", "left_anti").select(*self.nodes.columns)
        edges = self.edges.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_anti").select(*self.edges.columns)
        return PropertyGraph(kept.unionByName(new), edges, self.unique, self.closed)

    def merge(self, other: PropertyGraph, preserve_edges: bool = False) -> PropertyGraph:
        """Upsert other's nodes, then add its edges. preserve_edges keeps edges of replaced nodes whose ends still exist."""
        grown = self.upsert_nodes(other.nodes)
        if preserve_edges:
            fresh = self.edges.join(other.edges.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti").select(*self.edges.columns)
            # No id is lost by an upsert, so ends that were nodes still are.
            grown = PropertyGraph(grown.nodes, fresh if self.closed else existing(fresh, grown.nodes), closed=True)
        return grown.add_edges(other.edges)

    def with_communities(self, communities: DataFrame) -> PropertyGraph:
        """Nodes with the community of (id, community); ids it lacks keep theirs, unknown ids are ignored, edges equal by key fall together."""
        found = communities.select("id", F.col("community").cast("int").alias("assigned"))
        nodes = self.nodes.join(found, "id", "left").withColumn("community", F.coalesce("assigned", "community")).select(*self.nodes.columns)
        return PropertyGraph(nodes, self.distinct_edges(), True, self.closed)


def keep(df: DataFrame) -> DataFrame:
    """df checkpointed to the shared folder if one is set, else persisted."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again if one is set, else persisted: for loops.

    A checkpoint carries its plan's estimated size along, which each join multiplies, so the numbers that the driver works with
    double in length from round to round of a loop; a written table has the size of its files.
    """
    spark = df.sparkSession
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def existing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes: two semi joins; Spark broadcasts the ids where they are few enough."""
    ids = nodes.select("id")
    return edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select(*edges.columns)


def ends(edges: DataFrame, *keep: str) -> DataFrame:
    """(id, other, ...) for each end of each edge; a self loop gives one row."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), *keep)
    back = edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("other"), *keep)
    return out.unionByName(back)
