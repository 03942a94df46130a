"""Candidate pairs of the n-gram join that many keys bring together are made once."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from graphloom.llm import ngram_join


def test_a_pair_with_keys_in_many_buckets_is_made_once():
    words, buckets = [f"word{k}" for k in range(200)], 8
    texts = [" ".join(words), " ".join([*words[:100], "other", *words[101:]]), " ".join([*words[:50], "third", *words[51:]])]
    bound = ngram_join.Bound(8, 10)
    how = ngram_join.Parts(bound, np.zeros(0, np.uint64))
    loose = np.full(ngram_join.FILTER // 64, (1 << 64) - 1, np.uint64)
    batch = pa.RecordBatch.from_pydict({"id": [3, 5, 8], "text": texts, "label": [3, 5, 8]})
    sent = pa.Table.from_batches(list(ngram_join._send_loose(5, True, how, buckets, loose)(iter([batch]))))
    assert len(set(sent.column("bucket").to_pylist())) > 1
    made = []
    for k in sorted(set(sent.column("bucket").to_pylist())):
        out = ngram_join._cross(bound)(sent.filter(pa.compute.equal(sent.column("bucket"), k)))
        made += zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)
    assert sorted(made) == [(3, 5), (3, 8), (5, 8)]


def test_a_pair_without_first_keys_in_common_is_made_at_every_key():
    key, row = np.array([9, 4, 7, 4, 8], np.uint64), np.array([0, 0, 0, 1, 2])
    first = ngram_join._first_keys(key, row, 4)
    assert first[0, :4].tolist() == [4, 7, 9, int(ngram_join.NONE)] and (first[3] == ngram_join.NONE).all()
    at = np.array([4, 7, 8], np.uint64)
    assert ngram_join._made_here(at, first[[0, 0, 1]], first[[1, 1, 2]]).tolist() == [True, False, True]


def _sent(texts, buckets=8):
    how = ngram_join.Parts(ngram_join.Bound(8, 10), np.zeros(0, np.uint64))
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts, "label": list(range(len(texts)))})
    return pa.Table.from_batches(list(ngram_join._send_loose(5, True, how, buckets, np.full(1 << 10, (1 << 64) - 1, np.uint64))(iter([batch]))))


def _crossed(sent, nearest=False):
    made = set()
    for k in set(sent.column("bucket").to_pylist()):
        out = ngram_join._cross(ngram_join.Bound(8, 10), nearest)(sent.filter(pa.compute.equal(sent.column("bucket"), k)))
        made |= set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
    return made


def test_pairs_of_long_documents_that_share_a_passage_alone_are_not_made():
    passage = [f"common{k}" for k in range(1500)]
    texts = [" ".join([*passage, *(f"own{d}x{k}" for k in range(4000))]) for d in range(4)]
    near = texts[0].replace("own0x7 ", "other ")
    for nearest in (False, True):
        assert _crossed(_sent([*texts, near]), nearest) == {(0, 4)}


def test_further_parities_are_those_of_all_words():
    r = np.random.default_rng(3)
    sets = [np.sort(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (300, 2048, 2049, 9000, 9100)]
    sizes = np.array([len(x) for x in sets])
    few, first, many, words = ngram_join._parities(np.concatenate(sets), sizes)
    assert many.tolist() == [16, 16, 32, 128, 128]
    ids, large = np.array([7, 3, 9, 1, 4]), [2, 3, 4]
    at = np.concatenate([np.arange(16, many[k]) for k in large])
    of = np.concatenate([np.full(many[k] - 16, ids[k]) for k in large])
    finer = ngram_join.Finer(ids, few, of, at, np.concatenate([words[first[k] + 16 : first[k] + many[k]] for k in large]))
    apart = finer.apart(np.array([0, 3, 2]), np.array([3, 4, 3])).tolist()
    whole = np.bitwise_count(words[first[3] : first[3] + 128] ^ words[first[4] : first[4] + 128]).sum()
    assert apart[0] == 0 and apart[1] == whole and 0 < apart[2] <= 2049 + 9000


def test_the_filter_of_loose_keys_grows_with_them(spark):
    r = np.random.default_rng(5)
    keys, others = (r.integers(0, 1 << 40, 40000) for _ in range(2))
    words = ngram_join._filter(spark.createDataFrame([(int(k),) for k in keys], "loose long"))
    assert len(words) * 64 == 1 << 20 and ngram_join._may_hold(words, keys.view(np.uint64)).all()
    assert ngram_join._may_hold(words, others.view(np.uint64)).mean() < 0.02
    assert ngram_join._filter(spark.createDataFrame([], "loose long")) is None
