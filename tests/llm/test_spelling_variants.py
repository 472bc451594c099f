"""Pairs, forms and roots against brute force; filters; slices."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import spelling_variants as sv
from tests.llm.fixtures import awkward, nothing


def are_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_words(docs):
    import regex

    count = Counter()
    for doc_id, text in docs:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def slow(words):
    """Brute force over all pairs."""
    form, near = {}, {}
    for w in words:
        near[w] = [x for x in words if are_near(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def made_words(seed, n):
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(rng.choice("abcéÿ") for _ in range(rng.randint(7, 9)))
        out[w] = rng.choice([2, 3, 30, 400, 5000, 60_000])
    return out


def test_texts_to_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r["word"]: r["n"] for r in sv.vocabulary(sv.occurrences(docs)).collect()}
    assert got == slow_words([tuple(r) for r in docs.collect()]) and len(got) > 500


def test_whole_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = spark.createDataFrame(rows * 12, "doc_id bigint, text string")
    assert as_rows(sv.grouped(docs)) == slow(slow_words(rows * 12))


@pytest.mark.parametrize("broadcast_bytes", [sv.FILTER_BYTES, 256])
def test_dense_neighbourhoods_and_slices(spark, broadcast_bytes):
    words = made_words(4, 1200)
    vocab = spark.createDataFrame(list(words.items()), "word string, n bigint")
    expected = slow(words)
    assert as_rows(sv.variants(vocab, broadcast_bytes=broadcast_bytes)) == expected
    assert max(r[4] for r in expected) > 3 and any(r[2] != r[0] and r[2] != r[1] for r in expected)


def test_edits_are_all_there_and_few_others():
    words = list(made_words(9, 800))
    of = {}
    for length in sorted({len(w) for w in words}):
        own = sv._mixed(sv.hashes([w for w in words if len(w) == length]))
        f = of[length] = sv.Filter(sv.blocks_of(len(own)))
        at = sv._places(own, f.blocks).astype(np.int64)
        for word in range(8):
            np.bitwise_or.at(f.bits, (at, word), np.uint64(1) << sv._bit(own, word))
        assert len(f.holds(own)) == len(own)
    got = list(sv.edits(words, of))
    right = [(words[p], e) for p, e in got if e in set(words)]
    pairs = {(a, b) for a in words for b in words if are_near(a, b) and (len(a) > len(b) or len(a) == len(b) and a < b)}
    assert sorted(right) == sorted(pairs)  # each once
    assert len(got) - len(right) < 0.002 * 800 * 8 * len(sv.ALPHABET)


def test_very_long_words(spark):
    long = "abcdefgh" * 3000
    words = {long: 5, long + "x": 100, long[:-1]: 2, "y" + long[1:]: 60, "abcdefg": 4}
    vocab = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert as_rows(sv.variants(vocab)) == slow(words)


def test_awkward_texts(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert as_rows(sv.grouped(docs)) == slow(slow_words(rows))
    assert as_rows(sv.grouped(awkward(spark, 3))) == slow(slow_words(rows * 3))
    assert sv.grouped(nothing(spark)).count() == 0
