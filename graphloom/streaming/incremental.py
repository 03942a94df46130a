"""Keeping a graph up to date: content hashes, a cache of results, and a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import EDGE_KEY, EDGES, NODES, PropertyGraph, conform, existing, keep

#: Fixed value: paths whose changes don't matter.
IGNORED = r"(/\.|/bin/|/obj/)"


def last_changes(events: DataFrame) -> DataFrame:
    """The last event of each path (path, kind, content, ts), ignored paths left out; ties by kind."""
    x = events.where(~F.col("path").rlike(IGNORED))
    return x.groupBy("path").agg(F.max_by(F.struct("kind", "content", "ts"), F.struct("ts", "kind")).alias("e")).select("path", "e.*")


def changed(now: DataFrame, known: DataFrame) -> DataFrame:
    """(path, content_hash, state) of rows (path, content) that are new, differ from known (path, content_hash), or are gone.

    A null content is a deletion and counts as changed.
    """
    x = now.select("path", F.sha2("content", 256).alias("content_hash")).join(known.select("path", F.col("content_hash").alias("old")), "path", "left")
    state = F.when(F.col("content_hash").isNull(), "deleted").when(F.col("old").isNull(), "new").otherwise("changed")
    return x.where(~F.col("content_hash").eqNullSafe(F.col("old")) | F.col("content_hash").isNull()).select("path", "content_hash", state.alias("state"))


def ticks(events: DataFrame, width: str = "500 milliseconds") -> DataFrame:
    """(tick, path, kind): the last event of each path in each tick of event time."""
    x = events.where(~F.col("path").rlike(IGNORED)).withColumn("tick", F.window("ts", width).getField("start"))
    return x.groupBy("tick", "path").agg(F.max_by("kind", F.struct("ts", "kind")).alias("kind"))


class Cache:
    """Results by (key, content_hash) in Parquet: each put is a new version of its rows; reads take the last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = "key string, content_hash string, payload string, version long"

    def rows(self) -> DataFrame:
        """The last version of each key; a null payload is an invalidation. Nothing written yet is empty; a damaged file is an error."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            x = self.spark.read.schema(self.schema).parquet(self.path)
        else:
            x = self.spark.createDataFrame([], self.schema)
        newest = x.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version"))))
        return newest.where("r = 1 and payload is not null").select("key", "content_hash", "payload")

    def put(self, rows: DataFrame, version: int) -> None:
        """Rows (key, content_hash, payload)."""
        rows.select("key", "content_hash", "payload", F.lit(version).cast("long").alias("version")).write.mode("append").parquet(self.path)

    def hits(self, wanted: DataFrame) -> DataFrame:
        """Cached rows for (key, content_hash); other contents don't count."""
        return self.rows().join(wanted.select("key", "content_hash"), ["key", "content_hash"], "left_semi")

    def invalidate(self, keys: DataFrame, version: int) -> None:
        self.put(keys.select("key", F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("payload")), version)

    def exists(self, key: str) -> bool:
        return bool(self.rows().where(F.col("key") == key).limit(1).count())

    def clear(self, version: int) -> None:
        """Nothing is cached any more."""
        self.invalidate(self.rows(), version)

    def compact(self, to: str) -> None:
        """Only live rows, at a new path: nothing is read and overwritten at once."""
        self.rows().withColumn("version", F.lit(0).cast("long")).write.mode("overwrite").parquet(to)


def delete_paths(g: PropertyGraph, paths: DataFrame) -> PropertyGraph:
    """Without the nodes of paths (path), compared without case, and their edges."""
    gone = g.nodes.join(paths.select(F.lower("path").alias("p")).distinct(), F.lower("file_path") == F.col("p"), "left_semi").select("id")
    nodes = g.nodes.join(gone, "id", "left_anti").select(*g.nodes.columns)
    edges = g.edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select(*g.edges.columns)
    return PropertyGraph(nodes, edges)


def folder_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of events (path, kind, content, ts) from the JSON files that arrive in folder."""
    return spark.readStream.schema("path string, kind string, content string, ts timestamp").json(folder)


class Maintainer:
    """A graph as a keyed log: each micro-batch writes what it changes, and reads merge the log.

    A version's folder v<k> has the rows of that batch alone: nodes that are new or replaced, those that are gone (live
    is false), edges added, content hashes by path (null: gone) and communities that differ from the version before. A
    node's last row counts. An edge counts while neither of its ends was written in a later version, which is what an
    upsert means: it drops a node's edges. Every `compact` versions, and on compact(), what counts is written whole as
    base<k>; reads start at the last base. So a batch writes in proportion to its change, and a whole graph is written
    once in so many batches.

    extract: turns changed rows (path, content) into a graph of their nodes and edges. communities: gives (id,
    community) of the merged graph, such as detect(); edges equal by key then fall together, the last one stays. A
    version counts once its folder `done` is written, which comes last; a new Maintainer on an old folder goes on from
    the last such version. A batch that comes again after a failure starts from the version before its own and writes
    its own anew.
    """

    def __init__(self, spark: SparkSession, folder: str, extract: Callable[[DataFrame], PropertyGraph], communities: Callable[[PropertyGraph], DataFrame] | None = None, delete: bool = False, compact: int = 32):
        self.spark, self.folder, self.extract, self.communities, self.delete, self.every = spark, folder, extract, communities, delete, compact
        self.stream, self.version = "", max(self._complete("v"), default=-1)

    _TABLES = {
        "nodes": NODES + ", live boolean, version long",
        "edges": EDGES + ", version long",
        "hashes": "path string, content_hash string, version long",
        "communities": "id string, community int, version long",
    }

    def _complete(self, kind: str) -> list[int]:
        """Complete versions or bases in the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}*/done/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [int(f.getPath().getParent().getParent().getName()[len(kind) :]) for f in found or []]

    def _log(self, table: str, version: int) -> DataFrame:
        """Rows of the last base up to the version and of the versions after it, each with its version."""
        base = max((b for b in self._complete("base") if b <= version), default=-1)
        done = set(self._complete("v"))
        paths = [f"{self.folder}/base{base}/{table}"] * (base >= 0) + [f"{self.folder}/v{k}/{table}" for k in range(base + 1, version + 1) if k in done]
        if not paths:
            return self.spark.createDataFrame([], self._TABLES[table])
        return self.spark.read.schema(self._TABLES[table]).parquet(*paths)

    def _last(self, table: str, key: str, version: int) -> DataFrame:
        """The last row of each key."""
        x = self._log(table, version)
        rest = [c for c in x.columns if c != key]
        return x.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(key, "r.*")

    def _state(self, version: int) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges that count, with their versions."""
        last = self._last("nodes", "id", version)
        edges = self._log("edges", version)
        for end in ("src", "dst"):  # edges are added only where both ends are there
            own = last.select(F.col("id").alias(end), F.col("version").alias("since"), "live")
            edges = edges.join(own, end).where("live and version >= since").drop("since", "live")
        if self.communities:
            found = self._last("communities", "id", version).select("id", F.col("community").alias("assigned"))
            last = last.join(found, "id", "left").withColumn("community", F.coalesce("assigned", "community"))
            cols = [c for c in edges.columns if c not in EDGE_KEY]
            edges = edges.groupBy(*EDGE_KEY).agg(F.max_by(F.struct(*cols), F.struct("version", "weight", F.map_entries("metadata"))).alias("r")).select(*EDGE_KEY, "r.*")
        return last.where("live"), edges

    def load(self, version: int | None = None) -> PropertyGraph:
        nodes, edges = self._state(self.version if version is None else version)
        return PropertyGraph.of(nodes, edges)

    def known(self, version: int | None = None) -> DataFrame:
        """(path, content_hash)."""
        return self._last("hashes", "path", self.version if version is None else version).where("content_hash is not null").select("path", "content_hash")

    def _base(self, batch: int) -> int:
        """The version that the batch starts from: the last, or the one before its own if it was applied already."""
        done = max(self._complete("v"), default=-1)
        if done >= 0:
            last = self.spark.read.parquet(f"{self.folder}/v{done}/done").first()
            if (last.stream, last.batch) == (self.stream, batch):
                return last.base
        return done

    def _write(self, df: DataFrame, table: str, at: str, version: int | None = None) -> None:
        df = df if version is None else df.withColumn("version", F.lit(version).cast("long"))
        conform(df, self._TABLES[table]).write.mode("overwrite").parquet(f"{at}/{table}")

    def apply(self, events: DataFrame, batch: int) -> None:
        base = self._base(batch)
        new, at = base + 1, f"{self.folder}/v{base + 1}"
        self._delete(f"v{new}/done", f"v{new}", f"base{new}")  # what a failed try, or an earlier one of this batch, has left
        last = last_changes(events).persist()
        now = last.select("path", F.when(F.col("kind") != "deleted", F.col("content")).alias("content"))
        diff = changed(now, self.known(base)).persist()
        delta = self.extract(now.join(diff.where("state <> 'deleted'").select("path"), "path", "left_semi"))
        fresh = keep(delta.nodes)
        old, old_edges = self._state(base)
        gone = self.spark.createDataFrame([], "id string")
        if self.delete:
            paths = diff.where("state = 'deleted'").select(F.lower("path").alias("p")).distinct()
            gone = old.join(paths, F.lower("file_path") == F.col("p"), "left_semi").select("id").join(fresh.select("id"), "id", "left_anti")
        gone = keep(gone)
        self._write(fresh.withColumn("live", F.lit(True)).unionByName(gone.withColumn("live", F.lit(False)), allowMissingColumns=True), "nodes", at, new)
        there = old.select("id").join(gone, "id", "left_anti").unionByName(fresh.select("id"))
        self._write(existing(conform(delta.edges, EDGES), there), "edges", at, new)
        self._write(diff.select("path", "content_hash"), "hashes", at, new)
        if self.communities:
            # The version isn't complete yet: its rows are read beside those before it.
            nodes = fresh.unionByName(conform(old.join(fresh.select("id"), "id", "left_anti").join(gone, "id", "left_anti"), NODES))
            touched = fresh.select("id").unionByName(gone)
            kept = old_edges.join(touched.toDF("src"), "src", "left_anti").join(touched.toDF("dst"), "dst", "left_anti")
            edges = conform(kept, EDGES).unionByName(conform(self.spark.read.schema(self._TABLES["edges"]).parquet(f"{at}/edges"), EDGES))
            found = self.communities(PropertyGraph(keep(conform(nodes, NODES)), keep(edges))).select("id", F.col("community").cast("int").alias("community"))
            before = self._last("communities", "id", base).select("id", F.col("community").alias("was"))
            self._write(found.join(before, "id", "left").where("not community <=> was").select("id", "community"), "communities", at, new)
        self.spark.createDataFrame([(self.stream, batch, base)], "stream string, batch long, base long").write.mode("overwrite").parquet(f"{at}/done")
        self.version = new
        last.unpersist()
        diff.unpersist()
        if self.every and (new + 1) % self.every == 0:
            self.compact()

    def compact(self) -> None:
        """Write what counts of the last version as a base; further reads start there, and versions before it can go."""
        k = self.version
        if k < 0:
            return
        at = f"{self.folder}/base{k}"
        nodes, edges = self._state(k)
        self._write(nodes, "nodes", at)
        self._write(edges, "edges", at)
        self._write(self._last("hashes", "path", k).where("content_hash is not null"), "hashes", at)
        if self.communities:
            self._write(self._last("communities", "id", k).join(nodes.select("id"), "id", "left_semi"), "communities", at)
        self.spark.createDataFrame([(k,)], "version long").write.mode("overwrite").parquet(f"{at}/done")

    def vacuum(self) -> None:
        """Delete versions and bases that no read of the last version needs; older versions can't be loaded any more."""
        base = max(self._complete("base"), default=-1)
        self._delete(*[f"base{k}" for k in self._complete("base") if k < base], *[f"v{k}" for k in self._complete("v") if k <= base and k < self.version])

    def _delete(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def start(self, events: DataFrame, checkpoint: str, every: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
        """Run apply on a stream of events (path, kind, content, ts); with the same checkpoint it goes on where it stopped."""
        self.stream = checkpoint
        w = events.writeStream.foreachBatch(lambda df, k: self.apply(df, k)).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
