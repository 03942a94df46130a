"""Ranked lexical search: an inverted index in compressed blocks, searched by Block-Max WAND.

Index. A map task turns its documents into segments. Of each term a segment has the documents in order, cut into blocks
of BLOCK postings: gaps and counts, packed with as many bits as the block's largest needs. Beside the packed bytes stand
each block's last document and its impacts: the pairs (count, length) of the block that no other pair of it beats. A
term's largest score in a block follows from these at any corpus statistics, so that nothing is written again when N,
L or df change. Segments are files of one written table; nothing but df and length totals is shuffled.

Search. The blocks' last documents, known without decompression, cut a segment into stretches in which each term stays
in one block: a shallow move of all pointers to a stretch's end gives the sum of the blocks' largest scores, the most
that a document there can reach. Stretches below the item's threshold - its kth score so far, carried from segment to
segment - are skipped, and their blocks stay packed. In the others WAND's pivot rule applies: in order of their largest
scores here, terms that can't reach the threshold together don't propose documents. The proposed ones are scored term
by term, and one that can't reach the threshold any more opens no further block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import dealt, discard, materialize, small_batches, text_chunks

#: Postings in a block; postings and documents after which a segment ends; segments in a run that one task searches.
BLOCK, POSTINGS, DOCUMENTS, RUN = 128, 1 << 21, 1 << 16, 4
#: Terms of items that are sent to all tasks at most; with more of them all terms are indexed. Items in a group.
TERMS, GROUP = 1 << 20, 1024
#: Stretches that are looked at first; the number doubles as the threshold settles.
FIRST = 8

#: Bytes that part terms: ASCII but for letters and digits.
GAP = np.zeros(256, bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_ROW = "segment long, term long, df int, last binary, front binary, fronts binary, widths binary, packed binary"


def terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every term of a chunk of texts, A-Z as a-z."""
    s, e, doc = K.words(buf, offs, GAP)
    return K.span_hashes(buf, s, e, lower=True), doc


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def pack(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Blocks values[first[i]:first[i + 1]], each packed with the bits that its largest value needs: (bits, bytes)."""
    if not len(values):
        return np.zeros(0, np.uint8), []
    width = _bits(np.maximum.reduceat(values, first[:-1]))
    size = np.diff(first)
    out: list[bytes] = [b""] * len(size)
    for w in np.unique(width[width > 0]).tolist():
        for n in np.unique(size[width == w]).tolist():  # nearly all blocks are full
            at = np.flatnonzero((width == w) & (size == n))
            v = values[first[at][:, None] + np.arange(n)].astype(np.uint64)
            bits = ((v[:, :, None] >> np.arange(w, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(len(at), n * w)
            rows = np.packbits(bits, axis=1, bitorder="little")
            for k, row in zip(at.tolist(), rows, strict=True):
                out[k] = row.tobytes()
    return width, out


def unpack(data: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(data, bitorder="little")[: n * width].reshape(n, width)
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))


def segment_rows(number: int, term: np.ndarray, doc: np.ndarray, count: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Rows of one segment, from postings in order of (term, doc)."""
    begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    df = np.diff(np.append(begin, len(term)))
    blocks = -(-df // BLOCK)
    own = np.concatenate([[0], np.cumsum(blocks)])
    within = np.arange(own[-1]) - np.repeat(own[:-1], blocks)
    first = np.append(np.repeat(begin, blocks) + within * BLOCK, len(term)).astype(np.int64)
    gap = np.diff(doc, prepend=0)
    gap[begin] = doc[begin] + 1  # a list begins before the first document; gaps are 1 at least
    last = doc[first[1:] - 1].astype(np.int32) if len(term) else np.zeros(0, np.int32)
    gap_bits, gaps = pack(gap - 1, first)
    count_bits, counts = pack(count - 1, first)
    # The pairs of a block that nothing beats: in order of length, those with more occurrences than all before.
    block = np.repeat(np.arange(own[-1]), np.diff(first))
    n = length[doc]
    order = np.lexsort((-count, n, block))
    step = int(count.max(initial=0)) + 1
    rank = block[order] * step + count[order]
    best = np.maximum.accumulate(rank) if len(rank) else rank
    new = np.concatenate([[True], rank[1:] > best[:-1]]) if len(rank) else np.zeros(0, bool)
    at = order[new]
    fronts = np.concatenate([[0], np.cumsum(np.bincount(block[at], minlength=own[-1]))])
    pairs = np.stack([count[at], n[at]], 1).astype(np.int32)
    rows = {k: [] for k in ("last", "front", "fronts", "widths", "packed")}
    for i in range(len(begin)):
        a, b = own[i], own[i + 1]
        rows["last"].append(last[a:b].tobytes())
        rows["front"].append(pairs[fronts[a] : fronts[b]].tobytes())
        rows["fronts"].append((fronts[a + 1 : b + 1] - fronts[a]).astype(np.int32).tobytes())
        rows["widths"].append(np.stack([gap_bits[a:b], count_bits[a:b]]).tobytes())
        rows["packed"].append(b"".join(x for k in range(a, b) for x in (gaps[k], counts[k])))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(begin), number)), pa.array(term[begin].view(np.int64)), pa.array(df.astype(np.int32)), *(pa.array(rows[k], pa.binary()) for k in rows)],
        names=["segment", "term", "df", *rows],
    )


def _documents_row(number: int, ids: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """A segment's documents: their ids in last, their lengths in front; df counts those with a term."""
    cols = [pa.array([number], pa.int64()), pa.nulls(1, pa.int64()), pa.array([int((length > 0).sum())], pa.int32())]
    cols += [pa.array([x], pa.binary()) for x in (ids.astype(np.int64).tobytes(), length.astype(np.int64).tobytes(), int(length.sum()).to_bytes(8, "big"), b"", b"")]
    return pa.RecordBatch.from_arrays(cols, names=["segment", "term", "df", "last", "front", "fronts", "widths", "packed"])


def _index(wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 20
        ids, lengths, parts, docs, postings = [], [], [], 0, 0

        def flush():
            length = np.concatenate(lengths)
            term, doc, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((doc, term))
            yield segment_rows(number, term[order], doc[order], count[order], length)
            yield _documents_row(number, np.concatenate(ids), length)

        for batch, buf, offs in text_chunks(batches):
            h, doc = terms(buf, offs)
            length = np.bincount(doc, minlength=batch.num_rows)
            if wanted is not None:
                on = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
                h, doc = h[on], doc[on]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
            parts.append((h[new], doc[new] + docs, np.diff(np.append(new, len(h)))))
            ids.append(batch.column("id").to_numpy())
            lengths.append(length)
            docs, postings = docs + batch.num_rows, postings + len(new)
            if postings >= POSTINGS or docs >= DOCUMENTS:
                yield from flush()
                ids, lengths, parts, docs, postings = [], [], [], 0, 0
                number += 1
        if docs:
            yield from flush()

    return run


class Index:
    """A written index: `table` has a row for each segment and term, and one with a null term for its documents.

    pruned: it has only the terms that were wanted when it was built.
    """

    def __init__(self, table: DataFrame, pruned: bool = False):
        self.table, self.pruned = table, pruned
        rows = table.where("term is null").select("df", F.expr("cast(conv(hex(fronts), 16, 10) as long)").alias("n"))
        s = rows.agg(F.sum("df").alias("N"), F.sum("n").alias("L")).first()
        #: Documents with a term, and terms of all documents with repeats.
        self.documents, self.length = s.N or 0, s.L or 0

    def df(self) -> DataFrame:
        """(term, df) over all segments."""
        return self.table.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: DataFrame | None = None, path: str | None = None) -> Index:
    """The index of all rows of docs with an id, written to path or else to the shared folder.

    wanted: (term) hashes; if there are at most TERMS of them only their postings are kept, otherwise those of all
    terms. Statistics are of all terms of all documents in either case.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    keep = None
    if wanted is not None:
        some = wanted.select("term").distinct().limit(TERMS + 1).collect()  # checked size: 8 MB at most
        if len(some) <= TERMS:
            keep = np.sort(np.array([r.term for r in some], np.int64).view(np.uint64))
    rows = src.mapInArrow(_index(keep), _ROW)
    if path is None:
        return Index(materialize(rows, "index"), keep is not None)
    rows.write.parquet(path)
    return Index(docs.sparkSession.read.schema(rows.schema).parquet(path), keep is not None)


def _terms_of(batches: Iterator[pa.RecordBatch]):
    for batch, buf, offs in text_chunks(batches):
        h, doc = terms(buf, offs)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(h.view(np.int64))], names=["id", "term"])


class _List:
    """A term's postings in a segment; blocks are unpacked when first needed."""

    def __init__(self, row: dict, corpus: tuple[int, int]):
        self.last = np.frombuffer(row["last"], np.int32).astype(np.int64)
        pairs = np.frombuffer(row["front"], np.int32).astype(np.int64).reshape(-1, 2)
        ends = np.frombuffer(row["fronts"], np.int32)
        #: The largest score of each block, of a term with weight 1.
        self.most = np.maximum.reduceat(score(pairs[:, 0], pairs[:, 1], *corpus), np.concatenate([[0], ends[:-1]]))
        self.widths = np.frombuffer(row["widths"], np.uint8).reshape(2, -1).astype(np.int64)
        self.size = np.full(len(self.last), BLOCK)
        self.size[-1] = row["df"] - BLOCK * (len(self.last) - 1)
        sizes = -(-self.widths * self.size // 8)
        self.at = np.concatenate([[0], np.cumsum(sizes.T.ravel())])
        self.packed = np.frombuffer(row["packed"], np.uint8)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of block k."""
        if (found := self.open.get(k)) is None:
            n = int(self.size[k])
            a, b, c = self.at[2 * k : 2 * k + 3].tolist()
            gaps = unpack(self.packed[a:b], int(self.widths[0, k]), n) + 1
            doc = np.cumsum(gaps) + (self.last[k - 1] if k else -1)
            found = self.open[k] = doc, unpack(self.packed[b:c], int(self.widths[1, k]), n) + 1
        return found


def score(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What tf occurrences in a document of n terms score, for a term of weight 1."""
    m = 10 + (90 * n * documents) // max(length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Segment:
    """The postings of one segment that items ask for, and its documents."""

    def __init__(self, rows: list[dict], corpus: tuple[int, int]):
        self.corpus = corpus
        doc = next(r for r in rows if r["term"] is None)
        self.ids, self.length = (np.frombuffer(doc[k], np.int64) for k in ("last", "front"))
        self.lists = {r["term"]: _List(r, corpus) for r in rows if r["term"] is not None}

    def search(self, asked: list[tuple[int, int]], k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of an item's (term, weight) and of held, which has the best of other segments."""
        lists = [(self.lists[t], w) for t, w in asked if t in self.lists and w > 0]
        if not lists:
            return held
        # Stretches: up to which document each term's block stays the same.
        ends = np.unique(np.concatenate([x.last for x, _ in lists]))
        at = np.stack([np.searchsorted(x.last, ends) for x, _ in lists])
        most = np.stack([w * np.append(x.most, 0)[a] for (x, w), a in zip(lists, at, strict=True)])
        bound = most.sum(0)
        begins = np.concatenate([[0], ends[:-1] + 1])
        bar = int(held[0][-1]) if len(held[0]) == k else 1
        todo = np.argsort(-bound, kind="stable")
        done, many = 0, FIRST
        while done < len(todo):
            some = np.sort(todo[done : done + many])
            some = some[bound[some] >= bar]
            done, many = done + many, many * 2
            if not len(some):
                break
            held = self._stretches(lists, at[:, some], most[:, some], begins[some], ends[some], bar, k, held)
            bar = int(held[0][-1]) if len(held[0]) == k else 1
        return held

    def _stretches(self, lists, at, most, begins, ends, bar: int, k: int, held):
        # WAND's rule: in order of their largest scores, terms that stay below the bar together propose nothing.
        order = np.argsort(most, axis=0, kind="stable")
        weak = np.zeros(most.shape, bool)
        np.put_along_axis(weak, order, np.cumsum(np.take_along_axis(most, order, 0), 0) < bar, 0)
        found = []
        for (x, _), a, mild in zip(lists, at, weak, strict=True):
            on = (a < len(x.last)) & ~mild
            found += [x.block(b)[0] for b in np.unique(a[on]).tolist()]
        doc = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        where = np.searchsorted(ends, doc)
        on = (where < len(ends)) & (begins[np.minimum(where, len(ends) - 1)] <= doc)
        doc, where = doc[on], where[on]
        total, length = np.zeros(len(doc), np.int64), self.length[doc]
        # Strong terms first; a document that can't reach the bar with the rest opens no further block.
        order = np.argsort(-most.max(1), kind="stable")
        rest = most[order][::-1].cumsum(0)[::-1]
        live = np.arange(len(doc))
        for left, i in zip(rest, order.tolist(), strict=True):
            live = live[total[live] + left[where[live]] >= bar]
            if not len(live):
                return held
            x, w = lists[i]
            mine = doc[live]
            block = np.searchsorted(x.last, mine)
            for b in np.unique(block[block < len(x.last)]).tolist():
                d, tf = x.block(b)
                lo, hi = np.searchsorted(block, [b, b + 1])
                p = np.searchsorted(d, mine[lo:hi])
                hit = np.flatnonzero(d[np.minimum(p, len(d) - 1)] == mine[lo:hi])
                at_ = live[lo + hit]
                total[at_] += w * score(tf[p[hit]], length[at_], *self.corpus)
        keep = live[total[live] >= bar]
        scores, ids = np.concatenate([held[0], total[keep]]), np.concatenate([held[1], self.ids[doc[keep]]])
        best = np.lexsort((ids, -scores))[:k]
        return scores[best], ids[best]


def _searcher(corpus: tuple[int, int], k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        items = right.to_pylist()
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = [none] * len(items)
        segments = left.column("segment").to_numpy()
        for number in np.unique(segments).tolist() if items else []:
            segment = Segment(left.filter(pa.array(segments == number)).to_pylist(), corpus)
            for i, item in enumerate(items):
                held[i] = segment.search([(a["term"], a["w"]) for a in item["asked"]], k, held[i])
        out = [(np.full(len(s), item["item_id"]), ids, s) for item, (s, ids) in zip(items, held, strict=True)]
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [none[0]] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item_id", "doc_id", "score"), cols, strict=True)})

    return run


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, term), each once."""
    src = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return src.mapInArrow(_terms_of, "id long, term long").distinct()


def search(index: Index, asked: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index for each id of asked (id, term).

    A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))); a document of n terms scores weight * ((10^9 tf) div
    (1000 tf + 8 m)) for each term of the item, once, with m = 10 + (90 n N) div L. Only scores over 0 count; equal
    ones go by the smaller id.
    """
    spark = asked.sparkSession
    ratio = F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)
    weighed = asked.join(dealt(index.df()), "term").select("id", "term", F.floor(1000 * F.log(ratio)).cast("long").alias("w"))
    weighed = materialize(weighed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("asked")), "items")  # terms of one item's text
    groups = -(-weighed.count() // GROUP) or 1
    runs = -(-index.table.where("term is null").count() // RUN) or 1
    used = index.table
    if not index.pruned:
        used = used.where("term is not null").join(dealt(asked.select("term").distinct()), "term", "left_semi").select(*used.columns).unionByName(used.where("term is null"))
    rows = used.withColumn("run", F.pmod(F.xxhash64("segment"), F.lit(runs))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    items = weighed.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    items = items.select(F.col("id").alias("item_id"), "asked", "run", "grp")
    found = rows.groupBy("run", "grp").cogroup(items.groupBy("run", "grp")).applyInArrow(_searcher((index.documents, index.length), k), "item_id long, doc_id long, score long")
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    out = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of docs for each item; see search().

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z as a-z. A null or empty text has none. Rows
    with a null id take no part, on either side. Items without a term that some document has get no rows. Rows of docs
    that repeat an id are documents of their own; rows of items that repeat an id are one item with all their terms.
    Other columns are ignored, whatever their names. No documents or no items give no rows. Exact but for 64-bit hashes
    of terms.
    """
    asked = materialize(item_terms(items, item_col, item_text_col), "asked")
    index = build(docs, id_col, text_col, asked)
    out = materialize(search(index, asked, k), "ranked")
    discard(index.table, asked)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL = f"""
with d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) as term from documents where doc_id is not null),
t as (select doc_id, term, count(*) as tf from d group by all),
n as (select doc_id, cast(sum(tf) as bigint) as n from t group by all),
c as (select count(*) as docs, cast(sum(n) as bigint) as len from n),
f as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from t group by term), c),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) as term from benchmark where item_id is not null),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len)))) as bigint) as score
  from q join f using (term) join t using (term) join n using (doc_id), c group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0 qualify rank <= 10
"""
