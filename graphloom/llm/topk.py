"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt to blocks. Of each dimension a block has its rows sorted by that component; a query with a positive
weight walks a list from its top, one with a negative weight from its bottom. All lists are walked to the same
depth at a time, rows met for the first time are scored in full, and the walk ends once the best that an unseen row
could score - the sum over dimensions of weight times the component at this depth - is less than the kth score so
far. A query's kth score is carried from block to block, so later blocks start with a high bar. Queries go through
in groups, so that sorted access, bounds and scoring are array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Candidates in a block, candidate blocks in a task, and queries in a group.
ROWS, RUN, GROUP = 4096, 64, 1024


def _pack(table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    x = flat.reshape(len(ids), -1)[order]
    return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "x": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())})


class _Best:
    """The k best (scores, ids) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.parts: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n

    def bar(self) -> np.ndarray:
        """The kth score, or less than anything."""
        out = np.full(len(self.parts), np.iinfo(np.int64).min // 4)
        for q, p in enumerate(self.parts):
            if p is not None and len(p[0]) == self.k:
                out[q] = p[0][-1]
        return out

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        if (held := self.parts[q]) is not None:
            score, ids = np.concatenate([held[0], score]), np.concatenate([held[1], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.parts[q] = score[order], ids[order]


def search_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, best: _Best) -> int:
    """Threshold algorithm of queries q over one block; returns how many (query, row) scores it computed."""
    n, dims = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    ranked = np.take_along_axis(x, order, 0).astype(np.float64)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    small = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * dims < 2**53
    xf = x.astype(np.float64) if small else None
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], 0)
    live, scored, depth, before = np.arange(len(q)), 0, 0, 0
    positive, negative = (up > 0).astype(np.float32), (down < 0).astype(np.float32)
    bar = best.bar()
    while len(live):
        if before < n:
            bound = up[live] @ ranked[n - 1 - before] + down[live] @ ranked[before]
        else:
            bound = np.full(len(live), -np.inf)
        live = live[bound >= bar[live]] if before < n else live[:0]
        if not len(live):
            break
        depth = min(n, max(1, n // 16, before * 4))
        # Rows in the first `depth` of some list that the query walks, and not in the first `before` of any.
        def met(d: int) -> np.ndarray:
            if d >= n:
                return np.ones((len(live), n), bool)
            top, low = (place >= n - d).astype(np.float32), (place < d).astype(np.float32)
            return (positive[live] @ top.T + negative[live] @ low.T) > 0

        fresh = met(depth) & ~met(before) if before else met(depth)
        rows = np.flatnonzero(fresh.any(0))
        if small:
            score = np.rint(q[live].astype(np.float64) @ xf[rows].T).astype(np.int64)
        else:
            score = q[live] @ x[rows].T
        ok = fresh[:, rows]
        scored += int(ok.sum())
        ok &= (score >= bar[live][:, None]) & (ids[rows][None, :] != q_ids[live][:, None])
        for i, at in enumerate(live):
            hit = np.flatnonzero(ok[i])
            if len(hit):
                s = score[i, hit]
                if len(s) > 4 * best.k:
                    cut = np.partition(s, len(s) - best.k)[len(s) - best.k]
                    hit, s = hit[s >= cut], s[s >= cut]
                best.add(at, s, ids[rows[hit]])
        bar, before = best.bar(), depth
    return scored


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        is_q = table.column("is_query").to_numpy(zero_copy_only=False)
        dim = table.column("dim")[0].as_py()
        load = lambda mask: [(np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(v.as_buffer(), np.int64).reshape(-1, dim)) for i, v, m in zip(table.column("ids"), table.column("x"), mask, strict=True) if m]
        out = []
        blocks = sorted(load(~is_q), key=lambda b: b[0][0])
        for q_ids, q in load(is_q):
            best = _Best(len(q), k)
            for ids, x in blocks:
                search_block(x, ids, q, q_ids, best)
            for i, p in enumerate(best.parts):
                if p is not None:
                    out.append((np.full(len(p[0]), q_ids[i]), p[1], p[0]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return run


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by `every`, itself left out.

    Components become floor(scale * x); the score is their integer inner product; ties go to the smaller id. Vectors
    that are null or empty, or have a null or non-finite component, and rows with a null id take no part. Vectors
    of different lengths aren't compared. Ids are taken as unique; a row with the query's own id is never a candidate.
    Fewer than k others: all of them. Other columns are ignored; an empty table gives no rows.

    Every task compares one group of queries with at most RUN blocks of rows, and keeps k rows for each query.
    """
    v = F.col(vec_col)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    src = src.where("id is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    src = materialize(src.select("id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")), "vectors")
    n = src.count()
    blocks, groups = -(-n // ROWS) or 1, -(-n // (every * GROUP)) or 1
    runs = -(-blocks // RUN)
    packed = "dim int, ids binary, x binary"

    def deal(rows: DataFrame, parts: int) -> DataFrame:
        at = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        own = rows.select("id", "v", "dim", at.alias("part")).groupBy("dim", "part")
        return own.applyInArrow(lambda key, t: _pack(t).append_column("part", pa.array([key[1].as_py()], pa.int32())), packed + ", part int")

    rows = deal(src, blocks).withColumn("run", F.pmod("part", F.lit(runs)))
    rows = rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("dim", "ids", "x", "run", "grp", F.lit(False).alias("is_query"))
    asked = deal(src.where(F.pmod("id", F.lit(every)) == 0), groups)
    asked = asked.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).select("dim", "ids", "x", "run", F.col("part").alias("grp"), F.lit(True).alias("is_query"))
    found = rows.unionByName(asked).groupBy("dim", "run", "grp").applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
