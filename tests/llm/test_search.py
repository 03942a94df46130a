"""Lexical search, bottom-k near-dedup and hard negatives against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import hard_negatives, lexical, minhash
from graphloom.llm.components import components
from graphloom.llm.ngram_join import Bound

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Lexical search


def ranked(docs, items, k=10):
    """{(item, rank): (doc, score)} by the formula, document by document."""
    texts = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs if i is not None]
    n_docs, total = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = {}
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall(lowered(t)))
    for item, terms in asked.items():
        found = []
        for i, c in texts:
            m = 10 + (90 * sum(c.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, i))
        for r, (s, i) in enumerate(sorted(found)[:k], 1):
            out[item, r] = (i, -s)
    return out


def prose(seed, n, words=300, most=120):
    """Texts whose words are as uneven as those of prose, with copies, ties and odd ones."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeioustn") for _ in range(r.randint(1, 8))) for _ in range(words)]
    weight = [1 / (k + 1) for k in range(words)]
    texts = [" ".join(r.choices(vocab, weight, k=r.randint(0, most))) for _ in range(n)]
    texts += texts[:5] + [None, "", " .,-\n", "Ünïcode Straße 日本語 x", "ÜNÏCODE STRASSE", "a" * 9000, "one_two-three", "tie word", "tie word", "word tie", " ".join(vocab * 20)]
    return list(enumerate(texts)), vocab


def found(df):
    return {(r.item_id, r.rank): (r.doc_id, r.score) for r in df.collect()}


def tables(spark, docs, items):
    more = ["term", "segment", "w", "asked", "run", "grp", "id"]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    i = spark.createDataFrame(items, "item_id long, text string")
    return d.select("*", *[F.lit(k).alias(n) for k, n in enumerate(more)]), i.select("*", *[F.lit(k).alias(n) for k, n in enumerate(more)])


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search(spark, monkeypatch, small):
    if small:  # many segments, runs and groups
        for name, value in (("RUN", 2), ("GROUP", 5)):
            monkeypatch.setattr(lexical, name, value)
    docs, vocab = prose(1, 300)
    r = random.Random(2)
    items = [(k, " ".join(r.choices(vocab, k=r.randint(1, 30)))) for k in range(25)]
    items += [(90, None), (91, ""), (92, "nowhere else"), (93, "tie"), (94, "TIE Word, tie"), (95, "日本語 ünïcode"), (None, vocab[0]), (96, vocab[3]), (96, vocab[4]), (97, docs[7][1])]
    docs += [(None, vocab[0] + " lost"), (4, docs[4][1]), (5, "five " + vocab[9])]
    got, want = found(lexical.rank_documents(*tables(spark, docs, items))), ranked(docs, items)
    assert got == want and len(want) > 200


def test_lexical_search_of_a_written_index_of_all_terms(spark, monkeypatch, tmp_path):
    docs, vocab = prose(3, 120)
    items = [(1, " ".join(vocab[:8])), (2, vocab[200] + " nowhere")]
    d, i = tables(spark, docs, items)
    index = lexical.build(d, path=f"file://{tmp_path}/index")
    assert not index.pruned and found(lexical.search(index, lexical.item_terms(i))) == ranked(docs, items)
    monkeypatch.setattr(lexical, "TERMS", 3)  # too many to send: all are indexed
    assert found(lexical.rank_documents(d, i)) == ranked(docs, items)


def test_lexical_search_of_nothing(spark):
    docs, items = tables(spark, [(1, "a b"), (2, "c")], [(1, "a")])
    assert found(lexical.rank_documents(docs.limit(0), items)) == {}
    assert found(lexical.rank_documents(docs, items.limit(0))) == {}
    assert found(lexical.rank_documents(docs.withColumn("text", F.lit(None).cast("string")), items)) == {}


@pytest.mark.parametrize("n", [1, 5, 128, 300])
def test_packed_blocks_come_back(n):
    r = np.random.default_rng(n)
    for top in (1, 2, 255, 2**31 - 1):
        v = r.integers(0, top, n)
        first = np.append(np.arange(0, n, 128), n)
        width, data = lexical.pack(v, first)
        back = [lexical.unpack(np.frombuffer(d, np.uint8), int(w), b - a) for d, w, a, b in zip(data, width, first[:-1], first[1:], strict=True)]
        assert (np.concatenate(back) == v).all() and all(len(d) == -(-int(w) * (b - a) // 8) for d, w, a, b in zip(data, width, first[:-1], first[1:], strict=True))


def test_block_maxima_bound_and_skip():
    """No document scores more than its stretch's bound, and an item found whole in some documents opens few blocks."""
    r = np.random.default_rng(5)
    n, terms = 100_000, 30
    length = r.integers(150, 300, n)
    lists = [np.flatnonzero(r.random(n) < 0.02 + 0.4 / (t + 1)) for t in range(terms)]
    whole = r.choice(n, 12, replace=False)
    lists = [np.union1d(x, whole) for x in lists]
    term = np.concatenate([np.full(len(x), t) for t, x in enumerate(lists)]).astype(np.uint64)
    doc = np.concatenate(lists)
    count = 1 + (r.random(len(doc)) < 0.2)
    count[np.isin(doc, whole)] += 3
    corpus = (n, int(length.sum()))
    rows = lexical.segment_rows(0, term, doc, count, length).to_pylist() + lexical._documents_row(0, np.arange(n), length).to_pylist()
    segment = lexical.Segment(rows, corpus)
    asked = [(t, 100 + 100 * t) for t in range(terms)]
    total = np.zeros(n, np.int64)
    for t, x in enumerate(lists):
        on = term == t
        total[x] += asked[t][1] * lexical.score(count[on], length[x], *corpus)
        last = segment.lists[t].last
        assert (lexical.score(count[on], length[x], *corpus) <= segment.lists[t].most[np.searchsorted(last, x)]).all()
    scores, ids = segment.search(asked, 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    want = np.lexsort((np.arange(n), -total))[:10]
    assert ids.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    opened, blocks = sum(len(x.open) for x in segment.lists.values()), sum(len(x.last) for x in segment.lists.values())
    assert opened < 0.4 * blocks, (opened, blocks)


# Bottom-k near-dedup


def shingles(text, n):
    w = WORD.findall(lowered(text))
    return set(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else {tuple(w)} if w else set()


def components_of(texts, n, p, q):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i:
                inner = len(sets[i] & sets[j])
                if inner and q * inner >= p * (len(sets[i]) + len(sets[j]) - inner) and (a := root(i)) != (b := root(j)):
                    parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def near(df, **how):
    return {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_components(df, **how).collect()}


def near_table(spark, texts):
    names = ["id", "n", "bucket", "rep", "c", "size", "key", "kept", "component_id"]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return df.select("*", *[F.lit(k).alias(x) for k, x in enumerate(names)])


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    texts, passage = [], " ".join(r.choices(vocab, k=60))
    for size in (3, 4, 5, 7, 8, 9, 12, 20, 40, 70, 120, 400, 1500):
        for _ in range(3):
            base = r.choices(vocab, k=size)
            texts.append(" ".join(base))
            for edits in (1, 2, 3, 5, 8):  # about the threshold at some size
                x = list(base)
                for _ in range(max(1, edits * size // 100)):
                    x[r.randrange(size)] = r.choice(vocab)
                texts.append(" ".join(x))
                texts.append(" ".join(base[edits // 2 :] + r.choices(vocab, k=edits)))
    texts += [" ".join(r.choices(vocab, k=k)) + " " + passage for k in range(5, 200, 4)]
    texts += [None, "", " \n", "one", "ONE", "one two", "x" * 5000, *texts[:6], "same " * 300, "same " * 500]
    texts = dict(enumerate(texts))
    assert near(near_table(spark, texts)) == components_of(texts, 4, 8, 10)


def test_minhash_of_nothing_and_null_ids(spark):
    df = near_table(spark, {1: "a b c d e", 2: "a b c d e"})
    assert near(df.limit(0)) == {}
    both = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert near(both) == {1: (2, 1, True), 2: (2, 1, False)}
    with pytest.raises(ValueError, match=r"0\.8"):
        minhash.near_components(df, threshold=(7, 10))


def test_all_small_sets_at_the_threshold_share_a_run():
    r = np.random.default_rng(3)
    for u in range(2, 65):
        for _ in range(40):
            union = r.integers(0, 2**63, u).astype(np.uint64)
            f = u // 5
            only = r.permutation(u)[:f]
            cut = r.integers(0, f + 1)
            a, b = np.delete(union, only[:cut]), np.delete(union, only[cut:])
            flat = np.concatenate([np.sort(a), np.sort(b)])
            key, row, _ = minhash.Sketches(Bound(8, 10), np.zeros(0, np.uint64)).keys(flat, np.array([len(a), len(b)]))
            assert set(key[row == 0].tolist()) & set(key[row == 1].tolist()), u


def test_large_sets_at_the_threshold_share_a_run_and_pass_the_estimate():
    r = np.random.default_rng(4)
    how = minhash.Sketches(Bound(8, 10), np.zeros(0, np.uint64))
    for _ in range(2000):
        union = r.integers(0, 2**63, 1000).astype(np.uint64)
        a, b = np.sort(union[:900]), np.sort(union[100:])
        flat, sizes = np.concatenate([a, b]), np.array([900, 900])
        key, row, _ = how.keys(flat, sizes)
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())
        x, y = how.signatures(flat, sizes)
        assert how.likely(x, y, 900, 900)
    far = np.sort(r.integers(0, 2**63, 900).astype(np.uint64))
    assert not how.likely(*how.signatures(np.concatenate([a, far]), sizes), 900, 900)


def test_runs_of_a_common_passage_are_left_out():
    r = np.random.default_rng(6)
    common = r.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.sort(np.concatenate([common, r.integers(0, 2**63, 140).astype(np.uint64)])) for _ in range(300)]
    key, row, _ = minhash.Sketches(Bound(8, 10), np.sort(common)).keys(np.concatenate(sets), np.full(300, 200))
    most = Counter(key.tolist()).most_common(1)[0][1]
    assert most < 20 and (np.bincount(row, minlength=300) > 20).all()


# Hard negatives


def mined(rows, every=100, positives=5, negatives=5, low=80, high=100, scale=256):
    ok = [(i, l, tuple(math.floor(scale * float(x)) for x in v)) for i, l, v in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, l, v in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (l, len(v), v)), (l, len(v), v))
    out = set()
    for a, (label, _, q) in anchors.items():
        score = [(sum(x * y for x, y in zip(q, v, strict=True)), i, l) for i, l, v in ok if i != a and len(v) == len(q)]
        order = lambda r: (-r[0], r[1])
        for ps, p, _ in sorted([s for s in score if s[2] == label], key=order)[:positives]:
            some = sorted([s for s in score if s[2] != label and low * ps <= 100 * s[0] <= high * ps], key=order)[:negatives]
            out |= {(a, p, k, n, ps, s) for k, (s, n, _) in enumerate(some, 1)}
    return out


ROW = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def rows_found(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return [tuple(r[c] for c in cols) for r in df.collect()]


def vectors(seed, n, dims=8, tight=0.1):
    """Clusters that labels follow for the most part."""
    r = np.random.default_rng(seed)
    centers = r.normal(size=(6, dims))
    at = r.integers(0, 6, n)
    x = (centers[at] + tight * r.normal(size=(n, dims))).astype(np.float32)
    label = np.where(r.random(n) < 0.3, r.integers(0, 6, n), at)
    return [(k, int(label[k]), [float(v) for v in x[k]]) for k in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        for name, value in (("ROWS", 40), ("RUN", 2), ("GROUP", 4), ("TILE", 3), ("PIVOTS", 4), ("SAMPLE", 50)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(1, 600)
    rows += [(700, None, rows[0][2]), (None, 1, rows[0][2]), (800, 2, None), (900, 2, []), (1000, 2, [None] * 8), (1100, 2, [float("nan")] * 8), (1200, 2, [float("inf")] + [0.0] * 7), (1300, 3, [0.0] * 8)]
    rows += [(1400 + k, k % 2, rows[100][2]) for k in range(30)]  # ties
    rows += [(2000 + 10 * k, k % 3, [float(k), 1.0, -1.0]) for k in range(40)]  # other lengths
    rows += [(200, 5, rows[200][2]), (200, 0, rows[300][2]), (301, 1, rows[5][2])]  # repeated ids
    df = spark.createDataFrame(rows, ROW).repartition(5)
    df = df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(["id", "v", "dim", "cell", "part", "run", "grp", "anchor", "rank", "score"])])
    got = rows_found(hard_negatives.mine(df, every=20))
    want = mined(rows, every=20)
    assert set(got) == want and len(want) > 300


def test_hard_negatives_of_few_rows(spark):
    for n in (0, 1, 2, 3):
        rows = [(100 * k, k % 2, [1.0 + k, 2.0]) for k in range(n)]
        assert set(rows_found(hard_negatives.mine(spark.createDataFrame(rows, ROW)))) == mined(rows)
    same = [(k, 1, [1.0, 1.0]) for k in range(300)] + [(k, 2, [0.9, 1.0]) for k in range(300, 500)]
    got = rows_found(hard_negatives.mine(spark.createDataFrame(same, ROW)))
    assert set(got) == mined(same) and len(got) == len(set(got))


def test_brackets_hold_every_score_and_spare_most_of_tight_clusters():
    rows = vectors(7, 4000, dims=16, tight=0.05)
    x = np.floor(256 * np.array([r[2] for r in rows])).astype(np.int64)
    labels = np.array([r[1] for r in rows])
    norm2 = float((x * x).sum(1).max())
    pivots = hard_negatives.choose_pivots(hard_negatives.augmented(x[:500], norm2), 16)
    d = hard_negatives.distances(hard_negatives.augmented(x, norm2), pivots)
    q = x[::100]
    b = hard_negatives.Brackets(q, norm2, pivots)
    s = hard_negatives.scores(q, x)
    assert (s <= b.at_most(b.nearest(d, d))).all() and (s >= b.at_least(b.farthest(d))).all()
    everything = np.array([(-(2**62), 2**62)])
    found = hard_negatives.Search(np.arange(0, 4000, 100), labels[::100], q, [everything] * 40, norm2, pivots, 5, True)
    found.over([(np.arange(k, 4000, 8), labels[k::8], x[k::8], d[k::8]) for k in range(8)])
    assert found.scored < 0.5 * (labels[::100][:, None] == labels[None, :]).sum()
    for i in range(40):
        ok = np.flatnonzero((labels == labels[100 * i]) & (np.arange(4000) != 100 * i))
        best = ok[np.lexsort((ok, -s[i, ok]))[:5]]
        assert found.best.ids[i].tolist() == best.tolist()


# Components


def test_components_of_random_graphs_stars_and_paths(spark):
    r = random.Random(1)
    edges = [(r.randrange(1000), r.randrange(1000)) for _ in range(600)]
    edges += [(5000 + k, 5999) for k in range(300)]  # a hub larger than its neighbours
    path = r.sample(range(7000, 7200), 200)  # in no order
    edges += list(zip(path, path[1:], strict=False))
    edges += [(8000 + k, 8001 + k) for k in range(150)] + [(9000, 9000), (None, 3), (3, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {x.v: x.c for x in components(df).collect()} == {v: root(v) for v in list(parent)}
    assert components(df.limit(0)).count() == 0
