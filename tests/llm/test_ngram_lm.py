"""The Elias-Fano levels and the model against brute force."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ngram_lm
from plumbline.llm.elias_fano import EliasFano, Trie, _bit_packed, _bit_unpacked
from plumbline.llm.queries import QUERIES
from tests.llm.fixtures import awkward, nothing

def train():
    return F.crc32(F.col("doc_id").cast("string")) % 10 != 0



@pytest.mark.parametrize("n,top", [(0, 1), (1, 9), (1000, 10**6), (70_000, 70_000), (140_000, 2**64 - 1), (90_000, 12)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    data = EliasFano.encode(v)
    e = EliasFano(memoryview(data), 0)
    assert (e.values() == v).all() and e.end == len(data)
    keys = np.sort(np.concatenate((v[::5], rng.integers(0, top, 50, dtype=np.uint64))))
    at = e.find(keys)
    there = np.isin(keys, v)
    assert ((at >= 0) == there).all() and (v[at[there]] == keys[there]).all()
    if n > 1000:
        assert len(data) * 8 <= n * (3 + max(0, math.log2(top / n))) + 64 * 8 * 20


def brute(docs, order=3):
    split = lambda t: (t or "").encode().lower().split() + [b""]
    c, pairs, threes, contexts = Counter(), Counter(), Counter(), Counter()
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            w = split(t)
            c.update(w)
            pairs.update(zip([b"", *w], w))
            threes.update(zip([b"", *w], w, w[1:]))
            contexts.update(zip([b"", *w], w[:-1]))
    n, v = sum(c.values()), len(c)
    own = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    two = lambda a, b: (pairs[a, b] + ngram_lm.MU * own(b)) / (c[a] + ngram_lm.MU)
    three = lambda a, b, d: (threes[a, b, d] + ngram_lm.MU_TOP * two(b, d)) / (contexts[a, b] + ngram_lm.MU_TOP)
    out = []
    for i, t in docs:
        w = split(t)
        if order == 2:
            score = sum(math.log10(two(a, b)) for a, b in zip([b"", *w], w))
        else:
            score = math.log10(two(b"", w[0])) + sum(math.log10(three(*x)) for x in zip([b"", *w], w, w[1:]))
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(own(x)) for x in w), score))
    return sorted(out, key=repr)


def same(got, expected):
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert tuple(g[:4]) == e[:4]
        assert g[4] == pytest.approx(e[4], abs=1e-6)
        # Half a step of 1 / 65534 of a level's range, here about four powers of ten, for each token.
        assert g[5] == pytest.approx(e[5], rel=1e-4, abs=1e-3 + g[1] * 4 / 65534 / 2)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op5_ngram_lm"](spark, sf_dir)
    same(rows_of(got.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")), brute(docs))
    held = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]  # better than unigrams on texts not learned from


def test_blocks_and_shards_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    got = ngram_lm.score(docs, train(), block_tokens=5000, shard_words=500, shard_tokens=900)
    same(rows_of(got), brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_heavy_pairs_are_spread(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    blocks = ngram_lm.code(docs, train(), "doc_id", "text", 5000)
    words = ngram_lm.word_totals(blocks, 12)
    rows = docs.select("doc_id", "text").collect()
    pairs = Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 10:
            w = (r["text"] or "").encode().lower().split() + [b""]
            pairs.update(zip([b"", *w], w))
    found = ngram_lm.heavy(blocks, words, 60)
    assert sorted(found.counts.tolist()) == sorted(n for n in pairs.values() if n >= 60) and len(found.counts) > 5
    answers = ngram_lm.gram_scores(blocks, words, 70_000, 5_000, 4, 3, found, keep=True)
    assert sorted((r["shard"], r["order"]) for r in ngram_lm.tries(answers).select("shard", "order").collect()) == [(s, o) for s in range(4) for o in (2, 3)]
    got = ngram_lm.score(docs, train(), block_tokens=5000, shard_words=500, shard_tokens=60)
    same(rows_of(got), brute([(r["doc_id"], r["text"]) for r in rows]))


def test_order_two(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(rows_of(ngram_lm.score(docs, train(), order=2)), brute(rows, 2))
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    total = lambda found: sum(r[5] for r in found if r[0] in held)
    assert total(brute(rows, 3)) > total(brute(rows, 2))
    with pytest.raises(ValueError):
        ngram_lm.score(docs, train(), order=4)


def test_awkward_rows(spark):
    docs = awkward(spark, 2)
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    same(rows_of(ngram_lm.score(docs, train())), expected)
    assert ngram_lm.score(nothing(spark), train()).count() == 0
    for r in ngram_lm.score(docs, F.lit(False)).collect():
        assert r["train_tokens"] == r["n_known"] == 0 and r["score"] == pytest.approx(r["base_score"])


def test_trie_of_nothing():
    empty = np.empty(0, np.uint64)
    data = Trie.encode(empty, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0))
    got = Trie(memoryview(data)).score(np.array([3], np.uint64), np.array([4], np.uint64), np.array([-2.0]))
    assert got.tolist() == [-2.0]


@pytest.mark.parametrize("width", [0, 1, 7, 8, 20, 33, 56, 57, 63, 64])
def test_packed_bits(width):
    v = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64, endpoint=False) if 0 < width < 64 else np.zeros(1001, np.uint64)
    v = ~v if width == 64 else v
    raw = np.frombuffer(_bit_packed(v, width), np.uint8)
    assert len(raw) == -(-1001 * width // 8)
    assert not width or (_bit_unpacked(raw, 1001, width) == v).all()


def test_what_shards_send_back_is_small(spark, sf_dir):
    """Counts, which are few numbers many times over: 3 bytes a token and more when they were probabilities."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    blocks = ngram_lm.code(docs, train(), "doc_id", "text")
    none = np.empty(0, np.uint64)
    answers = ngram_lm.gram_scores(blocks, ngram_lm.word_totals(blocks, 1), 70_000, 5_000, 1, 3, ngram_lm.Heavy(none, none))
    size = answers.agg(F.sum(F.length("payload"))).first()[0]
    assert size < blocks.agg(F.sum("n_tokens")).first()[0]


def test_counts_of_a_small_table_are_exact(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    for g, e in zip(rows_of(ngram_lm.score(docs, train())), expected):
        assert g[5] == pytest.approx(e[5], rel=1e-9)
