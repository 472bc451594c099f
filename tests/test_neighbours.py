"""Neighbours, outlier factors and density clusters against brute force over all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators import neighbours as N
from plumbline.plans.components import components


def made(dimensions: int, seed: int = 1) -> np.ndarray:
    """A wide cloud, a tight one, a few far rows, copies, and one row thirty times more."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(120, dimensions)), rng.normal(size=(50, dimensions)) * 0.02 + 3, rng.uniform(-20, 20, (12, dimensions))])
    return np.concatenate([x, x[:10], x[:1].repeat(30, 0)])


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def brute_near(d, k):
    out = {}
    for i in range(len(d)):
        others = np.delete(np.arange(len(d)), i)
        far = np.sort(d[i, others])[min(k, len(others)) - 1]
        out[i] = (far, [j for j in others if d[i, j] <= far])
    return out


def brute_clusters(d, eps, least):
    n = len(d)
    core, label, c = [(d[i] <= eps).sum() >= least for i in range(n)], [-1] * n, 0
    for i in range(n):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], c
            while todo:
                u = todo.pop()
                for v in np.flatnonzero(d[u] <= eps):
                    if core[v] and label[v] < 0:
                        label[v] = c
                        todo.append(v)
            c += 1
    for i in range(n):
        near = [(d[i, j], j) for j in np.flatnonzero(d[i] <= eps) if core[j]]
        if not core[i] and near:
            label[i] = label[min(near)[1]]
    return {i: (label[i], bool(core[i])) for i in range(n)}


@pytest.mark.parametrize("dimensions", [1, 3])
def test_neighbours_and_outlier_factor(spark, dimensions):
    x = made(dimensions)
    df, near = table(spark, x), brute_near(distances(x), 8)
    got: dict = {}
    for r in N.neighbour_table(df, "id", "x", 8).collect():
        far, n = got.get(r["id"], (r["kdist"], 0))
        got[r["id"]] = (far, n + r["w"])
    assert all(abs(got[i][0] - near[i][0]) < 1e-9 and got[i][1] == len(near[i][1]) for i in near)
    d = distances(x)
    density = {i: 1 / (np.mean([max(d[i, j], near[j][0]) for j in near[i][1]]) + 1e-10) for i in near}
    expected = {i: np.mean([density[j] for j in near[i][1]]) / density[i] for i in near}
    found = {r["id"]: r["lof"] for r in N.outlier_factor(df, "id", "x", 8).collect()}
    assert all(abs(found[i] - expected[i]) < 1e-6 * expected[i] for i in expected)


@pytest.mark.parametrize(("dimensions", "eps", "least"), [(2, 0.15, 5), (2, 0.5, 6), (3, 1.5, 4)])
def test_density_clusters(spark, dimensions, eps, least):
    x = made(dimensions, 2)
    got = {r["id"]: (r["cluster"], r["core"]) for r in N.density_clusters(table(spark, x), "id", "x", eps, least).collect()}
    assert got == brute_clusters(distances(x), eps, least)


def test_full_cells_that_only_meet_at_a_corner(spark):
    """Two dense cells whose nearest points to each other's box are not within eps, though others are."""
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.uniform(0, 0.7, (200, 2)), [[0.7, 0.05]]])
    b = rng.uniform(0, 0.7, (200, 2)) + [0.71, 0.0]
    x = np.concatenate([a, b, rng.uniform(0, 0.7, (200, 2)) + [3.0, 0.0]])
    got = {r["id"]: (r["cluster"], r["core"]) for r in N.density_clusters(table(spark, x), "id", "x", 0.11, 3).collect()}
    assert got == brute_clusters(distances(x), 0.11, 3)


def test_sweep_goes_on_from_the_smaller_eps(spark):
    x = made(2, 4)
    d = distances(x)
    rows = N.eps_sweep(table(spark, x), "id", "x", 5, shares=(0.7, 0.9, 0.97)).collect()
    far = [np.sort(np.delete(d[i], i))[6] for i in range(len(d))]  # the row is its own first neighbour
    for r in rows:
        assert abs(r["eps"] - np.quantile(far, r["share"])) < 1e-9
        labels = [c for c, _ in brute_clusters(d, r["eps"], 5).values()]
        assert r["n_clusters"] == len(set(labels) - {-1}) and abs(r["noise"] - labels.count(-1) / len(labels)) < 1e-9
    assert sum(r["chosen"] for r in rows) <= 1 and all(r["noise"] <= 0.25 for r in rows if r["chosen"])


def test_awkward_points(spark):
    nan = float("nan")
    odd = [(1, [0.0]), (2, None), (3, [nan]), (4, [None])]
    df = spark.createDataFrame(odd, "id bigint, x array<double>")
    assert N.neighbour_table(df, "id", "x", 3).collect() == []
    assert [tuple(r) for r in N.outlier_factor(df, "id", "x", 3).collect()] == [(1, None)]
    assert [tuple(r) for r in N.density_clusters(df, "id", "x", 1.0, 2).collect()] == [(1, -1, False)]
    assert N.density_clusters(df.where("false"), "id", "x", 1.0, 2).collect() == []
    with pytest.raises(ValueError):
        N.neighbour_table(spark.createDataFrame([(1, [0.0] * 5)], "id bigint, x array<double>"), "id", "x", 3)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 3000 + i) for i in range(200)] + [(None, 1), (7, 7)]
    root = {}
    for a, b in links:
        for v in (a, b):
            root.setdefault(v, v)

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    expected = {v: find(v) for v in root if v is not None and any(v in (a, b) and a is not None for a, b in links)}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {v: r for v, r in expected.items()}


def test_blocks_of_any_size_find_the_same(spark, monkeypatch):
    """Points of many blocks, some asked by more points than one copy of a block takes."""
    x = made(3, 5)
    near = brute_near(distances(x), 4)
    monkeypatch.setattr(N, "ASKED", 7)
    points, names, dimensions = N.distinct_points(table(spark, x), "id", "x")
    found = names.join(N.nearest(points, 4, dimensions, size=9), "p").groupBy("id").agg({"w": "sum", "kdist": "max"}).collect()
    assert {r["id"]: (r["sum(w)"], pytest.approx(r["max(kdist)"])) for r in found} == {i: (len(q), far) for i, (far, q) in near.items()}


def test_points_without_enough_rows_around_are_not_paired(spark, monkeypatch):
    x = np.random.default_rng(8).uniform(0, 3, (400, 3))
    tables, written = [], N._written
    monkeypatch.setattr(N, "_written", lambda df: tables.append(written(df)) or tables[-1])
    found = N.density_clusters(table(spark, x), "id", "x", 0.5, 401).collect()
    assert sorted(tuple(r) for r in found) == [(i, -1, False) for i in range(400)]
    assert sum(t.count() for t in tables if "q" in t.columns) == 0


def test_points_at_the_edge_that_are_not_paired(spark):
    """A core row at the limit of eps, whose other rows are on its far side, at many places of the cells."""
    x = np.concatenate([np.concatenate([[[s, 0.0]], [[s - 0.95, 0.001 * i] for i in range(9)], [[s + 0.98, 0.0]]]) + [0.0, 7.0 * i] for i, s in enumerate(np.linspace(0, 1.1, 12))])
    points, _, dimensions = N.distinct_points(table(spark, x), "id", "x")
    at = points.withColumn("cell", N._cell("x", 0.7))
    assert N._crowded(at, points, dimensions, 1.0, 10).count() < len(x)
    got = {r["id"]: (r["cluster"], r["core"]) for r in N.density_clusters(table(spark, x), "id", "x", 1.0, 10).collect()}
    assert got == brute_clusters(distances(x), 1.0, 10) and all(c >= 0 for c, _ in got.values())
