"""A graph that is stored once and asked often.

Two tables, bucketed and sorted by node. `nodes` has a row for each node with what questions ask of it: degree, counts
of distinct edges in and out, and its first neighbours. `ends` has each edge under both of its nodes, with the label of
the node at the other end. So a search reads nodes alone; what is said of one node comes from one bucket; a hop of a
path sends its frontier to the edges, never the edges to the frontier.

The tables are Parquet with buckets: in the session's catalog under a name, and in a folder if one is given, from which
another session opens them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EDGE_KEY, EDGES, NODES, PropertyGraph, conform, confidence_name
from ..operators import metrics as M
from ..operators import query as Q
from ..operators import traverse as T

#: Neighbours kept with a node, in order of id and relationship.
FIRST = 20
#: Nodes of a frontier that are looked up by name, which reads their buckets only; larger ones are joined.
FEW = 64

_NODE = ", degree long, in_count long, out_count long, first array<struct<other:string,relationship:string>>"
_END = "id string, other string, outward boolean, relationship string, weight double, confidence_ord tinyint, other_label string, other_known boolean, copy int"


def _table(spark: SparkSession, name: str, schema: str, folder: str, buckets: int) -> None:
    columns = ", ".join(f"`{c.split(' ', 1)[0]}` {c.split(' ', 1)[1]}" for c in schema.split(", "))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{folder}'")


class GraphStore:
    """The five interactive queries over stored tables; results equal those over the graph they were made from."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.nodes, self.ends = spark.table(f"{name}_nodes"), spark.table(f"{name}_ends")

    @classmethod
    def save(cls, g: PropertyGraph, name: str, folder: str | None = None, buckets: int | None = None) -> GraphStore:
        """Write g, in place of what has the name. folder: where the tables lie, by default in the warehouse.

        buckets: by default the shuffle partitions, or half of the tasks that the edges are dealt to where these are more. Of edges with equal ends and relationship the most trusted, then
        the heaviest, stands for all where only distinct ones count.
        """
        spark = g.nodes.sparkSession
        n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), g.tasks // 2)
        cols = ["relationship", "weight", "confidence_ord", "copy"]
        best = Window.partitionBy(*EDGE_KEY).orderBy("confidence_ord", F.desc("weight"))
        edges = g.edges.withColumn("copy", F.lit(0) if g.unique else F.row_number().over(best) - 1)
        if g.sides is None:
            far = g.nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"), F.lit(True).alias("other_known"))
            out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(True).alias("outward"), *cols)
            back = edges.where("copy = 0").select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(False).alias("outward"), *cols)
            ends = out.unionByName(back).join(far, "other", "left").withColumn("other_known", F.coalesce("other_known", F.lit(False)))
        else:  # labels come with the edges, which are made once for both ends
            end = lambda own, other: F.struct(F.col(own).alias("id"), F.col(other).alias("other"), F.lit(own == "src").alias("outward"), *cols, F.col(f"{other}_label").alias("other_label"), F.lit(True).alias("other_known"))
            ends = g.sides({"label": F.col("label")}).withColumn("copy", F.lit(0)).select(F.inline(F.array(end("src", "dst"), end("dst", "src"))))
        ends = conform(ends, _END)
        for kind in ("nodes", "ends"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{kind}")

        def write(df: DataFrame, kind: str) -> None:
            w = df.repartition(n, "id").write.mode("overwrite").format("parquet").bucketBy(n, "id").sortBy("id")
            (w.option("path", f"{folder}/{kind}-{n}") if folder else w).saveAsTable(f"{name}_{kind}")

        write(ends, "ends")
        e = spark.table(f"{name}_ends").where("copy = 0")  # grouped by id where it lies
        seen = e.where("outward or id <> other")
        place = F.row_number().over(Window.partitionBy("id").orderBy("other", "relationship"))
        first = seen.withColumn("r", place).where(F.col("r") <= FIRST).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("r", "other", "relationship"))).alias("x"))
        first = first.select("id", F.transform("x", lambda s: F.struct(s["other"].alias("other"), s["relationship"].alias("relationship"))).alias("first"))
        counts = e.groupBy("id").agg(F.count_if(~F.col("outward")).alias("in_count"), F.count_if("outward").alias("out_count"))
        rows = (g.nodes if g.unique else M.with_degree(g)).join(counts, "id", "left").join(first, "id", "left")
        rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_count", "out_count")})
        rows = rows.withColumn("degree", F.col("in_count") + F.col("out_count")) if g.unique else rows
        rows = rows.withColumn("first", F.coalesce("first", F.array().cast("array<struct<other:string,relationship:string>>")))
        write(conform(rows, NODES + _NODE), "nodes")
        return cls(spark, name)

    @classmethod
    def open(cls, spark: SparkSession, name: str, folder: str) -> GraphStore:
        """The store that another session saved in folder."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/nodes-*")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if not found:
            raise FileNotFoundError(f"no stored graph in {folder}")
        n = max((f.getModificationTime(), int(f.getPath().getName().rpartition("-")[2])) for f in found)[1]
        for kind, schema in (("nodes", NODES + _NODE), ("ends", _END)):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{kind}")
            _table(spark, f"{name}_{kind}", schema, f"{folder}/{kind}-{n}", n)
        return cls(spark, name)

    def drop(self) -> None:
        """Take both tables out of the catalog, and their files out of the warehouse."""
        for kind in ("nodes", "ends"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")

    def edges(self) -> DataFrame:
        """Every edge once, parallel ones too."""
        return self.ends.where("outward").select(F.col("id").alias("src"), F.col("other").alias("dst"), "relationship", "weight", "confidence_ord")

    def graph(self) -> PropertyGraph:
        """Nodes and edges as a graph; metadata of edges isn't stored."""
        return PropertyGraph(conform(self.nodes, NODES), conform(self.edges(), EDGES))

    def search(self, term: str, limit: int = 10, connections: int = 5) -> DataFrame:
        """As query.search(), from the nodes alone. connections: FIRST at most."""
        if not term or not term.strip():
            raise ValueError("the search term is blank")
        if connections > FIRST:
            raise ValueError(f"a stored node has its first {FIRST} connections")
        low = F.lit(term.lower())
        hit = self.nodes.where(F.contains(F.lower("id"), low) | F.contains(F.lower("label"), low) | F.contains(F.lower("type"), low)).orderBy("id").limit(limit)
        near = F.array_join(F.transform(F.slice("first", 1, connections), lambda x: F.concat(x["relationship"], F.lit(":"), x["other"])), ", ")
        return hit.select("id", "label", "type", "degree", near.alias("connections"))

    def explain(self, node_id: str) -> DataFrame:
        """As query.explain(), from the node's row."""
        own = self.nodes.where(F.col("id") == node_id)
        role, how = Q.role(), Q.connectivity(F.col("in_count") + F.col("out_count"))
        return own.select("id", "label", "type", "file_path", "community", "in_count", "out_count", role.alias("role"), how.alias("connectivity"))

    def explain_edges(self, node_id: str) -> DataFrame:
        """As query.explain_edges(), from the node's bucket."""
        own = self.ends.where((F.col("id") == node_id) & (F.col("copy") == 0))
        way = F.when(F.col("outward"), "out").otherwise("in")
        x = own.select(way.alias("direction"), "relationship", "other", F.col("other_label").alias("label"), "weight", confidence_name(F.col("confidence_ord")).alias("confidence"))
        return x.orderBy("direction", "relationship", "other")

    def hop(self, frontier: DataFrame, ids: list[str] | None = None) -> DataFrame:
        """(src, dst) of the edges out of a frontier (id) to other known nodes; ids: its nodes, where they are few."""
        out = self.ends.where("outward and copy = 0 and other_known and id <> other")
        if ids is not None:
            return out.where(F.col("id").isin(ids)).select(F.col("id").alias("src"), F.col("other").alias("dst"))
        return out.join(frontier.select("id"), "id").select(F.col("id").alias("src"), F.col("other").alias("dst"))

    def shortest_path(self, source: str, target: str, max_hops: int | None = None) -> DataFrame:
        """As traverse.shortest_path(); each hop reads the frontier's edges where they lie."""

        def hop(frontier: DataFrame, n: int, k: int) -> DataFrame:
            if n <= FEW:
                return self.hop(frontier, [r.id for r in frontier.collect()])
            return self.hop(F.broadcast(frontier) if n <= T.BROADCAST else frontier)

        return T.path(self.nodes.select("id", "label"), hop, source, target, max_hops)

    def members(self, community: int) -> DataFrame:
        """(id, label, degree) of a community's nodes."""
        return self.nodes.where(F.col("community") == community).select("id", "label", "degree")

    def communities_overview(self, top: int = 5) -> DataFrame:
        """As query.communities_overview(), from the nodes alone."""
        place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
        own = self.nodes.where("community is not null").select("community", "id", "degree")
        best = own.withColumn("rank", place).where(F.col("rank") <= top).groupBy("community").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("m"))
        sizes = own.groupBy("community").agg(F.count("*").alias("size"))
        members: Column = F.array_join(F.transform("m", lambda s: s["id"]), ", ")
        return sizes.join(best, "community").select("community", "size", members.alias("members")).orderBy(F.desc("size"), "community")

    def statistics(self, isolated_at: int = 0) -> DataFrame:
        """As metrics.statistics(), from the nodes and a count of edges."""
        per = self.nodes.agg(F.count("*").alias("node_count"), F.countDistinct("community").alias("community_count"), F.coalesce(F.sum("degree"), F.lit(0)).alias("total"), F.count_if(F.col("degree") <= isolated_at).alias("isolated_node_count"))
        edges = self.ends.where("outward").agg(F.count("*").alias("edge_count"))
        return per.join(edges).select("node_count", "edge_count", "community_count", M.average_degree(F.col("total"), F.col("node_count")).alias("average_degree"), "isolated_node_count")

    def top_degree(self, n: int = 10) -> DataFrame:
        return self.nodes.select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(n)

    def analyze(self, n: int = 10) -> dict[str, DataFrame]:
        """As query.analyze(): only counts are shuffled."""
        s, edges = self.statistics(), self.edges()
        return {
            "statistics": s,
            "top_nodes": self.top_degree(n),
            "nodes_by_type": M.histogram(self.nodes, "type"),
            "edges_by_relationship": M.histogram(edges, "relationship"),
            "edges_by_confidence": M.histogram(edges.select(confidence_name(F.col("confidence_ord")).alias("confidence")), "confidence"),
            "mean_weight": Q.mean_weight(edges),
            "insights": Q.sentences(s, self.top_degree(1)),
        }
