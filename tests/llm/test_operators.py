"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import kernels as K
from graphloom.llm import bpe, bpe_codec, line_dedup, lm_score, ngram_join, packing, quality, registry, substring_dedup, token_counts, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, repeats and oddities."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeioust") for _ in range(r.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = [text(r.randint(60, 300)) for _ in range(20)]
    out = [*base, *base[:4]]
    for b in base[:8]:
        for k in (1, 3, 8):
            w = b.split()
            for _ in range(k):
                w[r.randrange(len(w))] = "edit" + str(r.random())
            out.append(" ".join(w))
    passage = text(40)
    out += [f"{text(30)} {passage}\n{text(20)}" for _ in range(5)]
    out += [None, "", "  \n\t ", "one", "one", "one two", "One TWO", "same " * 300, "Ünïcode Straße 日本語 " * 12, "a b  c ▁ d", "<|endoftext|> it's 'S", "x" * 5000, text(9), text(25) + "\n" + text(25) + "\n" + text(25)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = ["id", "n", "bucket", "at", "rep", "c", "size", "line", "key"]
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)]), dict(rows)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


@pytest.mark.parametrize(("n", "t"), [(3, (9, 10)), (5, (8, 10)), (2, (1, 2)), (3, (1, 1))])
def test_ngram_join(docs, n, t):
    df, texts = docs
    sets = {}
    for i, x in texts.items():
        w = words(x, True)
        sets[i] = set(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            inner, both = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and t[1] * inner >= t[0] * both and (a := root(i)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, n=n, threshold=t).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_ngram_join_of_hot_pivots_and_keys_in_parts(docs, monkeypatch):
    df, _ = docs
    whole = {r.id: r.component_id for r in ngram_join.ngram_components(df, n=3, threshold=(7, 10)).collect()}
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "LOCAL", 2)
    assert whole == {r.id: r.component_id for r in ngram_join.ngram_components(df, n=3, threshold=(7, 10)).collect()}


def test_ngram_join_links_sets_either_side_of_the_first_class_table(spark):
    w = [f"w{k}" for k in range(66_600)]
    rows = [(0, " ".join(w[:66_002])), (1, " ".join(w))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert {r.component_id for r in ngram_join.ngram_components(df, n=3, threshold=(9, 10)).collect()} == {0}


def near_copies(rng, words, n, m, edits):
    """m texts of n words, each a template with so many words replaced."""
    base = rng.choices(words, k=n)
    out = []
    for _ in range(m):
        x = list(base)
        for _ in range(edits):
            x[rng.randrange(n)] = rng.choice(words)
        out.append(" ".join(x))
    return out


def jaccard_components(texts, n, p, q):
    sets = [set(zip(*[t.split()[k:] for k in range(n)], strict=False)) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            inner = len(sets[i] & sets[j])
            if q * inner >= p * (len(sets[i]) + len(sets[j]) - inner) > 0 and (a := root(i)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def test_ngram_join_keeps_unrelated_documents_apart():
    rng, words = random.Random(5), [f"w{k}" for k in range(50_000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60, 300))) for _ in range(2000)]
    buf = np.frombuffer(" ".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) - 0
    offs[-1] -= 1
    s, e, d = K.words(buf, offs)
    flat, sizes = K.shingle_sets(K.span_hashes(buf, s, e), d, len(texts), 5)
    key, row, _ = ngram_join._part_keys(flat, sizes, ngram_join.Classes(ngram_join.Bound(8, 10)), np.zeros(0, np.uint64))
    pairs = set(zip(key.tolist(), row.tolist(), strict=True))
    shared = {k for k, n in Counter(k for k, _ in pairs).items() if n > 1}
    assert len(shared) < 20 and len({r for k, r in pairs if k in shared}) < 40


@pytest.mark.parametrize(("n", "t", "edits"), [(5, (8, 10), 4), (3, (9, 10), 3)])
def test_ngram_join_of_near_copies_and_a_common_passage(spark, n, t, edits):
    rng, words = random.Random(7), [f"w{k}" for k in range(3000)]
    texts = near_copies(rng, words, 120, 90, edits) + near_copies(rng, words, 40, 60, 1)
    passage = " ".join(rng.choices(words, k=60))
    texts += [f"{' '.join(rng.choices(words, k=rng.randrange(1, 60)))} {passage}" for _ in range(120)]
    texts += [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(100)] + [passage, texts[0], texts[0]]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.id: r.component_id for r in ngram_join.ngram_components(df, n=n, threshold=t).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_components(texts, n, *t)


def test_patterned_words_have_different_hashes(spark):
    def pattern(n):
        x = "a"
        while len(x) < n:
            x += x.translate(str.maketrans("ab", "ba"))
        return x

    for n in (1024, 2048, 8192):
        one = pattern(n)
        two = one.translate(str.maketrans("ab", "ba"))
        buf = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
        h = K.span_hashes(buf, *K.words(buf, np.array([0, len(buf)]))[:2])
        assert h[0] == h[2] != h[1]
        upper = np.frombuffer(one.upper().encode(), np.uint8)
        assert K.span_hashes(upper, np.array([0]), np.array([n]), True)[0] == h[0]
    x, y = pattern(1024), pattern(1024).translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(0, f"{x} q r"), (1, f"{y} q r"), (2, f"{x} q r")], "doc_id long, text string")
    assert {r.id: r.component_id for r in ngram_join.ngram_components(df, n=3, threshold=(9, 10)).collect()} == {0: 0, 1: 1, 2: 0}


def test_bpe_automaton_and_codec(docs):
    from tokenizers import Tokenizer

    tok, a = Tokenizer.from_file(BPE), bpe.automaton(BPE)
    r = random.Random(5)
    for w in ["".join(r.choice("aabinst'0é") for _ in range(r.randint(1, 20))) for _ in range(1500)]:
        assert a.encode(w) == tok.encode(w, add_special_tokens=False).ids
    df, texts = docs
    for x in bpe_codec.decode(bpe_codec.encode(df, BPE), BPE).collect():
        ids = tok.encode(texts[x.id] or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert (x.ids, x.n_tokens, x.decoded) == (ids, len(ids), back)
        assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and x.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


@pytest.mark.parametrize("most", [16, 2048])
def test_packing(docs, most):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    df, texts = docs
    rows = packing.pack(df, BPE, max_tokens=most).collect()
    ids = {i: [*tok.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}
    full, per = defaultdict(list), Counter()
    for x in rows:
        part = np.array(ids[x.id][x.start : x.start + x.length], "<u4")
        assert x.start == x.piece * most and zlib.crc32(part.tobytes()) == x.ids_crc32
        full[x.sequence_id].append((x.offset, x.length))
        per[x.id] += x.length
    assert per == {i: len(v) for i, v in ids.items()}
    for s in full.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= most
    assert len(full) <= -(-sum(map(len, ids.values())) // most) * 1.1 + 1


def test_best_fit_covers_every_rank_once():
    r = random.Random(3)
    counts = {n: r.randint(1, 60) for n in r.sample(range(1, 101), 60)}
    runs = packing.best_fit(counts, 100).tolist()
    seen, load = Counter(), Counter()
    for length, rank, n, first, _ in runs:
        for k in range(n):
            seen[length, rank + k] += 1
            load[first + k] += length
    assert seen == Counter({(n, k): 1 for n, c in counts.items() for k in range(c)}) and max(load.values()) <= 100
    one_by_one = []  # gaps after best fit of one piece at a time
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [g for g in one_by_one if g >= n]
        if fits:
            one_by_one.remove(min(fits))
        one_by_one.append((min(fits) if fits else 100) - n)
    assert len(load) <= len(one_by_one)


@pytest.mark.parametrize("base", [10, 5])
def test_substring_dedup(docs, base):
    df, texts = docs
    seen, want = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df, base=base).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500
    again = substring_dedup.dedup(df.unionByName(df.where("doc_id = 0")), base=base)
    assert again.where("id = 0").select("n_removed").distinct().collect()[0][0] == want[0][1]


def test_topk(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(r.normal(0, 1, 6), 1)]) for i in range(90)] + [(100, None), (101, [1.0] * 5 + [float("nan")]), (102, [1.0] * 5 + [None]), (103, []), (120, [0.0] * 6)]
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i < 100 or i == 120}
    want = []
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:20]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_of_few_vectors(spark):
    r = np.random.default_rng(7)
    for n in range(1, 16):
        x, q = r.integers(-9, 9, (n, 3)), r.integers(-9, 9, (2, 3))
        best = topk._Best(2, 4)
        topk.search_block(x, np.arange(n), q, np.array([0, 99]), best)
        for k, own in enumerate((0, 99)):
            want = sorted((-int(s), i) for i, s in enumerate(x @ q[k]) if i != own)[:4]
            assert [(-int(s), int(i)) for s, i in zip(*(best.parts[k] or ((), ())), strict=True)] == want
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(80, [1.0, 2.0, 3.0]), (81, [1.0, 0.0, 1.0]), (82, [0.0, 1.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 80").collect()
    assert [(x.vec_id, x.score) for x in sorted(got, key=lambda x: x.rank)] == [(81, 4 * 4096), (82, 2 * 4096)]


def test_quality_counts_and_viterbi(docs):
    df, texts = docs
    for x in quality.judge(df, quality.ALL_CONTENT).collect():
        t = texts[x.id] or ""
        w = words(t)
        g = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = [False] * len(w)
        for k in range(len(w) - 7):
            if g[tuple(w[k : k + 8])] > 1:
                rep[k : k + 8] = [True] * 8
        lines = [line for line in t.split("\n") if words(line)]
        failed = len(w) < 20 or 100 * sum(rep) > 30 * len(w)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(rep), failed, not failed)
    f = quality.Field((1.0,) + (0.0,) * 4, ((0.7, -0.3), (-0.5, 0.4)))
    r = random.Random(1)
    for _ in range(50):
        s = [r.uniform(-2, 2) for _ in range(r.randint(1, 7))]
        paths = [[b >> k & 1 for k in range(len(s))] for b in range(1 << len(s))]
        score = lambda y: sum(v for v, k in zip(s, y, strict=True) if k) + sum(f.step[a][b] for a, b in zip(y, y[1:], strict=False))
        assert score(f.decode(s)) == pytest.approx(max(map(score, paths)))


def test_quality_learns_junk(spark):
    r = random.Random(4)
    w = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    good = [" ".join(w() for _ in range(30)) + ".\n" + " ".join(w() for _ in range(30)) for _ in range(40)]
    junk = ["Header " + " ".join(w() for _ in range(4)) + "\n" + " | ".join(w() for _ in range(40)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + junk)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(60)], "doc_id long, quality int")
    field = quality.fit(df, labels)
    assert {r.id for r in quality.judge(df, field).collect() if r.kept} == set(range(40))
    assert quality.keep_content(df, field).count() == 40
    assert quality.fit(df, labels.limit(0)) == quality.ALL_CONTENT


def test_quality_fit_sees_late_lines(spark):
    r = random.Random(8)
    w = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    clean = lambda: "\n".join(" ".join(w() for _ in range(6)) for _ in range(quality.STRETCH))
    junk = lambda: "\n".join(" | ".join(w() for _ in range(6)) for _ in range(quality.STRETCH))
    rows = [(i, clean() + "\n" + (clean() if i < 20 else junk())) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = quality.fit(df, spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int"))
    for x in quality.judge(df, field, marks=True).collect():
        assert x.line_labels == [1] * quality.STRETCH + [int(x.id < 20)] * quality.STRETCH


def test_token_counts(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df, texts = docs
    got = {r.id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, PIECES, limit=300).collect()}
    want = {i: (len((x or "").encode()), n := len(sp.encode(x or "")), n > 300) for i, x in texts.items()}
    assert got == want


def test_warc_round_trip_and_damage(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nInjected: 1", None), (4, "b", ""), (5, "c", "é" * 100_000)]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    body = {i: (h or "").encode() for i, _, h in pages}
    kinds = {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None)}
    assert got == {i: (len(b), warc.digest(b), *kinds[i]) for i, b in body.items()}
    one = warc.page_record(7, "u", b"payload", None, "d")
    assert [p for _, _, p in warc.read(one + one)] == [b"payload"] * 2 and list(warc.read(b"")) == []
    with pytest.raises(warc.WarcError):
        list(warc.read(one[:-9]))
    wrong = warc.record("urn:page:1", "response", b"HTTP/1.1 200 OK\r\n\r\nx", {"WARC-Payload-Digest": "sha1:" + warc.digest(b"y")})
    with pytest.raises(warc.WarcError):
        list(warc.read(wrong))


def test_line_dedup(spark):
    a = "the quick brown foxes jumped over several extremely lazy dogs yesterday evening near the riverbank"
    rows = [(0, f"{a}\nunique words standing alone quietly here"), (1, f"Heading\n{a.upper()}!\nshort line"), (2, None), (3, ""), (4, f"short line\n{a.replace('lazy', 'lazi')}"), (5, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got[0] == (2, 0, rows[0][1]) and got[1] == (3, 1, "Heading\nshort line")
    assert got[2] == (0, 0, None) and got[3] == (1, 0, "") and got[4] == (2, 1, "short line") and got[5] == (1, 1, "")


def test_line_dedup_takes_short_lines(spark, tmp_path):
    han = "".join(chr(0x4E00 + 7 * k) for k in range(60))
    rows = [(0, f"All rights reserved.\n\n-----\n{han}"), (1, f"all rights reserved\n\n-----\n{han}"), (2, f"{han[:30]}{han[31:]}\nAll")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in line_dedup.query(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 3, 2: 1}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_finds_lines_with_an_edited_word(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    rows = []
    for k in range(60):
        w = [word() for _ in range(r.randint(5, 40))]
        at = r.randrange(len(w))
        new = [[*w[:at], word(), *w[at + 1 :]], [*w[:at], word(), *w[at:]], [*w[:at], *w[at + 1 :]], [*w[:at], w[at][:1] + "z" + w[at][1:], *w[at + 1 :]]][k % 4]
        a, b = " ".join(w), " ".join(new)
        rows += [(2 * k, a), (2 * k + 1, b)] if edits(a, b) <= 0.2 * max(len(a), len(b)) else []
    got = {x.id for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.n_removed}
    assert len(rows) > 90 and got == {i for i, _ in rows if i % 2}


def test_line_dedup_against_edit_distances_of_all_pairs(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    lines = []
    for _ in range(40):
        w = r.choices(vocab, k=r.randint(5, 30))
        for _ in range(r.randint(1, 4)):
            x = list(w)
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(x))
                x[at : at + r.randint(0, 1)] = r.choice([[], [r.choice(vocab)], [x[at][::-1]], [x[at], x[at] + "s"]])
            lines.append(" ".join(x))
    passage = " ".join(r.choices(vocab, k=12))
    lines += [f"{' '.join(r.choices(vocab, k=12))} {passage}" for _ in range(25)] + ["a b c d e f"] * 12
    r.shuffle(lines)
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if abs(len(lines[i]) - len(lines[j])) <= 0.2 * max(len(lines[i]), len(lines[j])) and edits(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i for i in range(len(lines)) if root(i) != i}
    got = {x.id for x in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), least_words=1).collect() if x.n_removed}
    assert got <= want and len(got) >= 0.95 * len(want) > 40


def test_lm_scores_beat_word_counts(spark):
    r = random.Random(9)
    nxt = {k: [r.randrange(40) for _ in range(2)] for k in range(40)}
    texts = []
    for _ in range(300):
        k, out = r.randrange(40), []
        for _ in range(80):
            out.append(f"w{k}")
            k = r.choice(nxt[k])
        texts.append(" ".join(out))
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    got = lm_score.score(df, every=2, rounds=3).collect()
    n = Counter(w for t in texts for w in t.split())
    total = sum(n.values())
    flat = sum(v * np.log(v / total) for v in n.values()) / total
    assert sum(x.log_prob for x in got) / total > flat + 0.2
    none = {x.id: (x.n_tokens, x.log_prob, x.mean_log_prob) for x in got if x.id >= 900}
    assert none == {900: (0, 0.0, None), 901: (0, 0.0, None)}


def test_lm_scores_equal_a_plain_forward_pass(spark, monkeypatch, docs):
    df, texts = docs
    made = {}

    def fixed(src, vocab, rounds, every):
        made.update(vocab=vocab, flat=lm_score.initial(vocab, 5))
        return made["flat"]

    monkeypatch.setattr(lm_score, "fit", fixed)
    got = {r.id: (r.n_tokens, r.log_prob) for r in lm_score.score(df).collect()}
    vocab, w = made["vocab"], [x.astype(np.float64) for x in lm_score.unflatten(made["flat"])]
    names = sorted({x for t in texts.values() for x in words(t, True)})
    buf = np.frombuffer(" ".join(names).encode(), np.uint8)
    ids = dict(zip(names, vocab.lookup(K.span_hashes(buf, *K.words(buf, np.array([0, len(buf)]))[:2])).tolist(), strict=True))
    assert min(ids.values()) > 0  # all words are known here

    def log_share(z, k):
        return z[k] - np.log(np.exp(z).sum())

    for i, t in texts.items():
        tokens, total = [ids[x] for x in words(t, True)], 0.0
        for at, y in enumerate(tokens):
            around = [tokens[j] if 0 <= (j := at + d) < len(tokens) else lm_score.EDGE for d in (-2, -1, 1, 2)]
            x = np.maximum(w[1] + sum(w[0][k][c] for k, c in enumerate(around)), 0)
            g, m = y % lm_score.GROUPS, y // lm_score.GROUPS
            total += log_share(x @ w[2] + w[3], g) + log_share(x @ w[4][g] + w[5][g], m)
        assert got[i][0] == len(tokens) and got[i][1] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_lm_rest_words_score_by_their_counts(spark):
    known = " ".join(f"w{k}" for k in range(lm_score.SIZE - 1))
    rest = [*["aa"] * 4, *["bb"] * 2, "cc"]
    rows = [(0, " ".join([known] * 5)), (1, "w1 aa w2"), (2, "w1 bb w2"), (3, "w1 cc w2"), (4, "w1 aa w2"), (None, "w1 aa w2"), (5, "aa\naa bb")]
    assert Counter(w for i, t in rows if i for w in t.split() if w[0] != "w") == Counter(rest)
    got = {r.id: r.log_prob for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] - got[3] == pytest.approx(np.log(4)) and got[2] - got[3] == pytest.approx(np.log(2))
    assert got[1] == pytest.approx(got[4]) == pytest.approx(got[None])


def test_lm_rounds_train_on_every_window_once(spark, monkeypatch, docs):
    seen = []
    monkeypatch.setattr(lm_score, "train_step", lambda w, sums, c, y: seen.append(len(y)))
    rows = spark.createDataFrame([(i, x) for i, x in docs[1].items() if x], "id long, text string")
    vocab = lm_score.vocabulary(rows)
    batches = rows.toArrow().to_batches()

    class Shared:
        value = vocab, lm_score.initial(vocab)

    for turn in range(lm_score.ROUNDS):
        list(lm_score._train(Shared, lm_score.EVERY, turn)(iter(batches)))
    assert sum(seen) == sum(len(words(x)) for x in docs[1].values())


def test_empty_tables(spark):
    e = empty(spark)
    frames = [ngram_join.ngram_components(e), bpe_codec.encode(e, BPE), packing.pack(e, BPE), substring_dedup.dedup(e), token_counts.count_tokens(e, PIECES), quality.judge(e, quality.ALL_CONTENT), line_dedup.dedup_lines(e), lm_score.score(e), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")), warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_registry_names():
    assert sorted(registry.queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1])) == list(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())
