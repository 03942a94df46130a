"""Hard negatives by a pivot table.

Every vector x gets one more component, the root of M^2 - |x|^2, where M is the largest norm; an anchor's further
component is 0. Then distance(anchor, x)^2 = M^2 + |anchor|^2 - 2 * score, so scores are brackets of distances. Stored
with each row are its distances to a few pivots. By the triangle inequality a pivot p brackets the distance of a row
from an anchor: |d(a, p) - d(x, p)| <= d(a, x) <= d(a, p) + d(x, p). Rows whose bracket lies outside what an anchor can
still use are never scored; the others are, in integers.

Rows fall into cells by their nearest pivot and cells into blocks, which have the least and largest distance to each
pivot: a block outside the bracket isn't looked at row by row. Anchors are sent to runs of blocks, in groups; so rows
and anchors are each copied n / (rows of the other side in a task) times. A first pass finds each anchor's positives, a
second one the rows of other labels whose scores lie in a positive's window. Each keeps a bar, the kth score so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt, discard, materialize

#: Pivots for each length of vectors, rows that they are chosen from, rows in a block, blocks in a run, anchors in a group and in a tile of it.
PIVOTS, SAMPLE, ROWS, RUN, GROUP, TILE = 16, 1024, 4096, 64, 1 << 16, 256
#: Share of a squared distance that rounding may take, many times over.
SLACK = 1e-9
_LEAST = np.iinfo(np.int64).min // 4

_BLOCK = "dim int, run long, ids binary, labels binary, x binary, far binary"
_ASKED = "anchor long, label long, dim int, v array<long>, windows array<struct<low:long,high:long,positive_id:long>>"


def choose_pivots(x: np.ndarray, m: int) -> np.ndarray:
    """m rows of x, each the farthest from those before; fewer if rows coincide."""
    if not len(x):
        return x
    at = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < m and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def augmented(x: np.ndarray, norm2: float) -> np.ndarray:
    """Rows with a further component that gives each the norm sqrt(norm2)."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))[:, None]], 1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of every row to every pivot, summed without cancellation."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1) if len(pivots) else np.zeros((len(x), 0))


class Brackets:
    """Bounds of scores between anchors and rows from their distances to pivots."""

    def __init__(self, anchors: np.ndarray, norm2: float, pivots: np.ndarray):
        q = anchors.astype(np.float64)
        own = (q * q).sum(1)
        self.base = norm2 + own
        self.slack = SLACK * (self.base + 1)
        self.d = distances(np.concatenate([q, np.zeros((len(q), 1))], 1), pivots)

    def at_most(self, least: np.ndarray, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        """The highest score at these distances or more."""
        return (self.base[rows, None] - least * least) / 2 + self.slack[rows, None]

    def at_least(self, most: np.ndarray, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        return (self.base[rows, None] - most * most) / 2 - self.slack[rows, None]

    def nearest(self, low: np.ndarray, high: np.ndarray, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Lower bounds of the distances to rows whose distances to pivots lie between low and high (one row for each)."""
        out = np.zeros((len(self.d[rows]), len(low)))
        for j in range(low.shape[1]):
            d = self.d[rows, j][:, None]
            np.maximum(out, d - high[None, :, j], out=out)
            np.maximum(out, low[None, :, j] - d, out=out)
        return out

    def farthest(self, high: np.ndarray, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        out = np.full((len(self.d[rows]), len(high)), np.inf)
        for j in range(high.shape[1]):
            np.minimum(out, self.d[rows, j][:, None] + high[None, :, j], out=out)
        return out


class _Best:
    """The k best (score, id) of each slot so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids, self.bar = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n, np.full(n, _LEAST)

    def add(self, slot: int, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > 4 * self.k:
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[score >= cut], ids[score >= cut]
        score, ids = np.concatenate([self.score[slot], score]), np.concatenate([self.ids[slot], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[slot], self.ids[slot] = score[order], ids[order]
        if len(order) == self.k:
            self.bar[slot] = score[order[-1]]


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where these are exact, since they multiply faster."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Search:
    """Anchors with windows of scores against blocks of rows; counts the pairs that it was asked about and those it scored.

    same: rows of the anchor's own label but for itself, else rows of other labels. Each window (low, high) of an
    anchor keeps its k best rows with low <= score <= high.
    """

    def __init__(self, ids, labels, q, windows: list[np.ndarray], norm2: float, pivots: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.q, self.same, self.norm2, self.pivots = ids, labels, q, same, norm2, pivots
        self.first = np.concatenate([[0], np.cumsum([len(w) for w in windows])]).astype(int)
        flat = np.concatenate([*windows, np.zeros((0, 2), np.int64)])
        self.low, self.high = flat[:, 0], flat[:, 1]
        self.best = _Best(len(flat), k)
        self.asked = self.scored = 0

    def _wanted(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that each anchor can still use."""
        low = np.maximum(self.low, self.best.bar)
        lows, highs = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
        for i, r in enumerate(rows.tolist()):
            a, b = self.first[r], self.first[r + 1]
            use = low[a:b] <= self.high[a:b]
            if use.any():
                lows[i], highs[i] = low[a:b][use].min(), self.high[a:b][use].max()
        return lows, highs

    def over(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """blocks: (ids, labels, vectors, distances to pivots) each."""
        lows = np.array([b[3].min(0) for b in blocks]).reshape(len(blocks), -1)
        highs = np.array([b[3].max(0) for b in blocks]).reshape(len(blocks), -1)
        order = np.argsort(distances(np.concatenate([self.q.astype(np.float64), np.zeros((len(self.q), 1))], 1), self.pivots).argmin(1), kind="stable") if len(self.pivots) else np.arange(len(self.q))
        for i in range(0, len(order), TILE):
            rows = order[i : i + TILE]
            bracket = Brackets(self.q[rows], self.norm2, self.pivots)
            near, far = bracket.nearest(lows, highs), bracket.farthest(highs)
            top, bottom = bracket.at_most(near), bracket.at_least(far)
            for b in np.argsort(near.mean(0), kind="stable").tolist():
                least, most = self._wanted(rows)
                on = np.flatnonzero((top[:, b] >= least) & (bottom[:, b] <= most))
                self.asked += len(rows) * len(blocks[b][0])
                if len(on):
                    self._block(rows, on, bracket, least[on], most[on], *blocks[b])

    def _block(self, rows, on, bracket, least, most, ids, labels, x, d) -> None:
        own = self.labels[rows[on]][:, None] == labels[None, :]
        want = (own & (self.ids[rows[on]][:, None] != ids[None, :])) if self.same else ~own
        want &= bracket.at_most(bracket.nearest(d, d, on), on) >= least[:, None]
        if not self.same:  # without an upper end nothing is too near
            want &= bracket.at_least(bracket.farthest(d, on), on) <= most[:, None]
        cols = np.flatnonzero(want.any(0))
        if not len(cols):
            return
        self.scored += int(want.sum())
        s = scores(self.q[rows[on]], x[cols])
        want = want[:, cols] & (s >= np.maximum(least, _LEAST)[:, None]) & (s <= np.minimum(most, np.iinfo(np.int64).max // 2)[:, None])
        for i in np.flatnonzero(want.any(1)).tolist():
            hit = np.flatnonzero(want[i])
            for slot in range(self.first[rows[on[i]]], self.first[rows[on[i]] + 1]):
                h = hit[(s[i, hit] >= max(self.low[slot], self.best.bar[slot])) & (s[i, hit] <= self.high[slot])]
                if len(h):
                    self.best.add(slot, s[i, h], ids[cols[h]])


def _blocks(norms: dict[int, float], pivots: dict[int, np.ndarray]):
    """A block of its rows, with their distances to the pivots."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        d = distances(augmented(x, norms[dim]), pivots[dim])
        small = len(x) and np.abs(x).max() < 1 << 15
        x = np.ascontiguousarray(x.astype(np.int16 if small else np.int64))
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "run": pa.array([table.column("part")[0].as_py() // RUN], pa.int64()),
            **{n: pa.array([a.tobytes()], pa.binary()) for n, a in (("ids", ids), ("labels", labels), ("x", x), ("far", d))},
        })

    return run


def _searcher(norms, pivots, k: int, same: bool):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        none = [np.zeros(0, np.int64)] * 5
        out = [none]
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            blocks = []
            for row in left.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["x"], np.int16 if len(row["x"]) == 2 * dim * len(ids) else np.int64).reshape(len(ids), dim).astype(np.int64)
                blocks.append((ids, np.frombuffer(row["labels"], np.int64), x, np.frombuffer(row["far"], np.float64).reshape(len(ids), -1)))
            blocks.sort(key=lambda b: b[0][0])
            asked = right.sort_by("anchor")
            windows = [np.array([(w["low"], w["high"]) for w in ws], np.int64).reshape(-1, 2) for ws in asked.column("windows").to_pylist()]
            of = [[w["positive_id"] for w in ws] for ws in asked.column("windows").to_pylist()]
            q = asked.column("v").combine_chunks().flatten().to_numpy().reshape(asked.num_rows, dim)
            s = Search(asked.column("anchor").to_numpy(), asked.column("label").to_numpy(), q, windows, norms[dim], pivots[dim], k, same)
            s.over(blocks)
            for i, anchor in enumerate(s.ids.tolist()):
                for j in range(s.first[i], s.first[i + 1]):
                    n = len(s.best.ids[j])
                    out.append([np.full(n, anchor), np.full(n, j - s.first[i]), s.best.ids[j], s.best.score[j], np.full(n, of[i][j - s.first[i]] or 0)])
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "slot", "id", "score", "positive_id"), cols, strict=True)})

    return run


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of anchors.

    Components become floor(scale * x); scores are integer inner products, higher ones first, ties by smaller id.
    Anchors are rows whose id is divisible by `every`. Their positives are the first rows of their label but for
    themselves; a positive's negatives the first rows of other labels with low * positive_score <= 100 * score <=
    high * positive_score. Fewer: all. Rows with a null id or label, a null or empty vector, or a null or non-finite
    component take no part; nor do vectors with a component of 2^27 / sqrt(length) or more once scaled, so that a
    hundred times a score fits 64 bits. Vectors of different lengths aren't compared. Rows that repeat an id are all candidates,
    but never of an anchor with that id; as anchors they are one, the row with the smallest label and vector. Other
    columns are ignored; an empty table gives no rows.

    The pivots come from at most SAMPLE rows of each length, drawn by a hash of the id; every row is in the table. They
    only decide how many pairs are scored, not which are found.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    src = src.where("id is not null and label is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * F.lit(float(scale)) < F.lit(2.0**27) / F.sqrt(F.size("v")))))
    src = materialize(src.select("id", "label", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")), "rows")
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    kinds = {r["dim"]: r for r in src.groupBy("dim").agg(F.max(norm2).alias("m")).collect()}  # a row for each length
    norms, pivots = {d: float(r["m"]) for d, r in kinds.items()}, {}
    for d in kinds:
        some = src.where(F.col("dim") == d).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        pivots[d] = choose_pivots(augmented(np.array([x.v for x in some], np.int64), norms[d]), PIVOTS)
    if not kinds:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def cell(batches):
        for batch in batches:
            dims, out = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            offs, flat = batch.column("v").offsets.to_numpy(), batch.column("v").values.to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = flat[offs[at][:, None] + np.arange(d)]
                out[at] = distances(augmented(x, norms[d]), pivots[d]).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "cell"])

    filed = src.mapInArrow(cell, "id long, label long, dim int, v array<long>, cell long")
    sizes = filed.groupBy("dim", "cell").agg(F.count("*").alias("m")).collect()  # at most PIVOTS for each length
    first, rows = {}, []
    for r in sorted(sizes, key=lambda r: (r["dim"], r["cell"])):
        own = -(-r["m"] // ROWS)
        rows.append((r["dim"], r["cell"], first.get(r["dim"], 0), own))
        first[r["dim"]] = first.get(r["dim"], 0) + own
    place = spark.createDataFrame(rows, "dim int, cell long, at long, own long")
    filed = filed.join(F.broadcast(place), ["dim", "cell"]).withColumn("part", F.col("at") + F.pmod(F.xxhash64("id", "cell"), F.col("own")))
    blocks = materialize(filed.select("id", "label", "dim", "v", "part").groupBy("dim", "part").applyInArrow(_blocks(norms, pivots), _BLOCK), "blocks")
    runs = spark.createDataFrame([(d, -(-n // RUN)) for d, n in first.items()], "dim int, runs long")
    anchors = src.where(F.pmod("id", F.lit(every)) == 0).groupBy("id", "dim").agg(F.min(F.struct("label", "v")).alias("x")).groupBy("id").agg(F.min(F.struct("x.label", "dim", "x.v")).alias("x"))
    anchors = materialize(anchors.select(F.col("id").alias("anchor"), "x.label", "x.dim", "x.v"), "anchors")
    groups = -(-anchors.count() // GROUP) or 1

    def ask(asked: DataFrame, k: int, same: bool) -> DataFrame:
        left = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = asked.join(F.broadcast(runs), "dim").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)))
        right = right.withColumn("grp", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")).drop("runs")
        found = left.groupBy("dim", "run", "grp").cogroup(right.groupBy("dim", "run", "grp")).applyInArrow(_searcher(norms, pivots, k, same), "anchor long, slot long, id long, score long, positive_id long")
        by = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    all_ = F.array(F.struct(F.lit(-(2**62)).cast("long").alias("low"), F.lit(2**62).cast("long").alias("high"), F.lit(0).cast("long").alias("positive_id")))
    liked = materialize(ask(anchors.withColumn("windows", all_), positives, True).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    p = F.col("positive_score")
    span = F.struct("rank", F.expr(f"-(({-int(low)} * positive_score - pmod({-int(low)} * positive_score, 100)) div 100)").alias("low"), F.expr(f"({int(high)} * positive_score - pmod({int(high)} * positive_score, 100)) div 100").alias("high"), "positive_id", p.alias("positive_score"))
    windows = liked.groupBy("anchor").agg(F.sort_array(F.collect_list(span)).alias("w"))  # at most `positives` for an anchor
    asked = materialize(anchors.join(dealt(windows), "anchor"), "asked")
    narrow = asked.select("anchor", "label", "dim", "v", F.transform("w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), w["positive_id"].alias("positive_id"))).alias("windows"))
    found = ask(narrow, negatives, False)
    scored = asked.select("anchor", F.posexplode("w").alias("slot", "s")).select("anchor", F.col("slot").cast("long").alias("slot"), F.col("s.positive_score").alias("positive_score"))
    out = found.join(dealt(scored), ["anchor", "slot"])
    out = materialize(out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    discard(src, blocks, anchors, liked, asked)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))


ORACLE_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from e a join e c on a.vec_id <> c.vec_id and len(a.v) = len(c.v) where a.vec_id % 100 = 0),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, cast(row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as int) as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
qualify rank <= 5
"""
