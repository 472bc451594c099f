"""Recall against brute force, the exact scores and order, and awkward vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hash_forest as hf
from plumbline.llm.queries import QUERIES


def brute(rows, asks, k):
    """{query id: [(id, score)]}; rows (id, vector) are usable ones with distinct ids."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if asks(i):
            v = np.array(v, float)
            s = (x * v).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(v))
            order = sorted((-a, b) for a, b in zip(s.tolist(), ids.tolist()) if b != i)[:k]
            out[i] = [(b, -a) for a, b in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in expected[q]]
        assert np.allclose([s for _, s in found], [s for _, s in expected[q]], atol=1e-12)


def test_query_on_given_tables_is_exact_where_a_shard_is_small(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    same(answers(QUERIES["op12_hash_forest"](spark, sf_dir)), brute(rows, lambda i: i % 50 == 0, 5))


@pytest.fixture(scope="module")
def mixed():
    """12,000 vectors without structure, and 3,000 around a few points."""
    rng = np.random.default_rng(3)
    points = rng.standard_normal((30, 64))
    x = np.concatenate((rng.standard_normal((12_000, 64)), np.repeat(points, 100, axis=0) + 0.05 * rng.standard_normal((3000, 64))))
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


def test_recall_at_production_parameters(spark, mixed):
    df = spark.createDataFrame(mixed, "vec_id bigint, embedding array<float>").repartition(4)
    got = answers(hf.search(df, F.col("vec_id") % 50 == 0, 5))
    expected = brute(mixed, lambda i: i % 50 == 0, 5)
    assert got.keys() == expected.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 5 for q in expected]
    assert np.mean(hits) >= 0.9 and np.mean([h for q, h in zip(expected, hits) if q >= 12_000]) >= 0.99
    exact = {q: dict(expected[q]) for q in expected}
    assert all(abs(s - exact[q][i]) < 1e-12 for q in got for i, s in got[q] if i in exact[q])


def test_few_candidates_are_compared(mixed):
    x = np.array([v for _, v in mixed], float)[-8000:]
    forest = hf.Forest(x, trees=16)
    sizes = [len(c) for c in forest.candidates(x[-200:], 200)]
    assert max(sizes) < 2500  # dense places ask for long prefixes
    assert all(i in set(c.tolist()) for i, c in zip(range(len(x) - 200, len(x)), forest.candidates(x[-200:], 200)))


def test_prefix_ranges(mixed):
    forest = hf.Forest(np.array([v for _, v in mixed[:500]], float), trees=3)
    asked = np.stack([forest.hashed(forest.x[:20], t) for t in range(3)])
    for length in (0, 1, 7, 64):
        low, high = forest.ranges(asked, length)
        for t in range(3):
            strings = [f"{int(s):064b}" for s in forest.hashed(forest.x, t)]
            for q in range(20):
                expected = {i for i, s in enumerate(strings) if s[:length] == strings[q][:length]}
                assert set(forest.order[t][low[t, q] : high[t, q]].tolist()) == expected


def test_hot_vector_ties_and_shards(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (900, 6)).astype(float)
    x[::3] = [1, 0, 2, 0, 0, 1]  # one vector in a third of the rows
    x[np.abs(x).sum(axis=1) == 0] = 1
    rows = [(int(i), v) for i, v in zip(rng.permutation(900), x.tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    expected = brute(rows, lambda i: i % 20 == 0, 5)
    for shard_rows, block in ((10_000, 512), (64, 7)):
        got = answers(hf.search(df, F.col("vec_id") % 20 == 0, 5, shard_rows=shard_rows, block=block))
        assert got.keys() == expected.keys()
        # Equal vectors have equal scores, so their ids are the least; others may tie but for rounding.
        for q in got:
            assert np.allclose([s for _, s in got[q]], [s for _, s in expected[q]], atol=1e-12)
            if dict(rows)[q] == [1, 0, 2, 0, 0, 1]:
                assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (50, [-1.0, 0.0])]
    bad = [(100, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [])]
    schema = "vec_id bigint, embedding array<double>, id string, v string, shard int"
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in good + bad + good[:2]], schema)
    got = answers(hf.search(df, F.col("vec_id") % 50 == 0, 5))
    same(got, brute(good, lambda i: i % 50 == 0, 5))
    assert all(len(x) == 3 for x in got.values())
    assert hf.search(df.where("false"), F.col("vec_id") % 50 == 0, 5).collect() == []
    assert hf.search(df.where("vec_id = 0"), F.lit(True), 5).collect() == []
