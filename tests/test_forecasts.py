"""Stationarity tests against least squares, horizons, naive models and the quantile forest."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluation as E
from plumbline.operators import horizons as H
from plumbline.operators import quantile_forest as Q
from plumbline.operators import stationarity as T


def series(spark, y):
    return spark.createDataFrame([(i + 1000, float(v)) for i, v in enumerate(y)], "i bigint, y double").repartition(3)


def slow_adf(y, p):
    d = np.diff(y)
    x = np.column_stack([np.ones(len(d) - p), y[p:-1], *[d[p - k : -k] for k in range(1, p + 1)]])
    b, *_ = np.linalg.lstsq(x, d[p:], rcond=None)
    e = d[p:] - x @ b
    return b[1] / np.sqrt(e @ e / (len(e) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])


def slow_kpss(y, l):
    e = y - y.mean()
    g = [e[k:] @ e[: len(e) - k] / len(e) for k in range(l + 1)]
    return (np.cumsum(e) ** 2).sum() / len(e) ** 2 / (g[0] + 2 * sum((1 - k / (l + 1)) * g[k] for k in range(1, l + 1)))


def test_noise_and_random_walk(spark):
    noise = np.random.default_rng(2).normal(size=1500)
    for y, verdict in ((noise, "stationary"), (np.cumsum(noise), "unit root")):
        rows = {r["test"]: r for r in T.stationarity(series(spark, y), "i", "y", adf_lags=3).collect()}
        assert abs(rows["adf"]["statistic"] - slow_adf(y, 3)) < 1e-6 and rows["adf"]["n"] == 1496
        assert abs(rows["kpss"]["statistic"] - slow_kpss(y, rows["kpss"]["lags"])) < 1e-8
        assert {r["verdict"] for r in rows.values()} == {verdict}
        assert all(0.01 <= r["p_value"] <= 0.1 for r in rows.values())
    with pytest.raises(ValueError):
        T.kpss(series(spark, [1.0] * 50), "i", "y")
    with pytest.raises(ValueError):
        T.dickey_fuller(series(spark, noise[:12]), "i", "y", 3)


@pytest.fixture(scope="module")
def hours(spark):
    rng = np.random.default_rng(8)
    i = np.arange(700)
    y = 50 + 20 * np.sin(2 * np.pi * i / 24) + 8 * np.sin(2 * np.pi * i / 168) + rng.normal(size=700)
    return y, series(spark, y)


def test_no_horizon_uses_what_is_not_known_yet(spark, hours):
    y, df = hours
    table = H.feature_table(df, "i", "y")
    names = [c for c in table.columns if c not in ("i", "y")]
    assert {"lag_1", "delta_24", "mean_24", "mean_168"} <= set(names) - set(H.known(table, names, 2))
    assert H.known(table, names, 24) == ["lag_24", "lag_48", "lag_168", "hour_sin", "hour_cos"]
    rows = {r["i"]: r for r in table.collect()}
    r = rows[1500]
    assert r["lag_24"] == y[476] and abs(r["mean_24"] - y[476:500].mean()) < 1e-9 and abs(r["delta_24"] - (y[499] - y[475])) < 1e-9
    found = {r["horizon"]: r for r in H.horizon_study(table, "i", names, [1, 24, 168], 1560, 10.0).collect()}
    assert len({r["n"] for r in found.values()}) == 1 and found[1]["mae"] < 3 and all(abs(r["mase"] - r["mae"] / 10) < 1e-12 for r in found.values())
    assert all(int(c[4:]) >= h for h, r in found.items() for c in r["features"].split(",") if c.startswith("lag_"))
    with pytest.raises(ValueError):
        H.horizon_study(table, "i", ["lag_1"], [6], 1560)


def test_naive_models(spark, hours):
    y, df = hours
    cut = 1500
    found = {r["model"]: r["mae"] for r in H.errors(H.naive_forecasts(df, "i", "y", cut), ["model"], "y", "p", None).collect()}
    late, past = np.arange(501, 700), y[:501]
    by_hour = {h: past[(np.arange(501) + 1000) % 24 == h].mean() for h in range(24)}
    expected = {"mean": past.mean(), "last": y[late - 1], "day": y[late - 24], "week": y[late - 168], "hour": np.array([by_hour[(i + 1000) % 24] for i in late])}
    assert all(abs(found[m] - np.abs(y[late] - p).mean()) < 1e-9 for m, p in expected.items())
    ahead = {(r["horizon"], r["model"]): r["mae"] for r in H.horizon_naive(df, "i", "y", [1, 30], cut).collect()}
    assert abs(ahead[30, "last"] - np.abs(y[late] - y[late - 30]).mean()) < 1e-9 and abs(ahead[30, "season"] - np.abs(y[late] - y[late - 48]).mean()) < 1e-9


def test_quantile_forest(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, 3000)
    y = 3 * x + rng.normal(size=3000) * (1 + x)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id bigint, x double, y double")
    forest = Q.fit(df.where("id % 3 != 0"), ["x"], "y", least=40)
    rows = forest.predict(df.where("id % 3 = 0"), ["id", "y"])
    report = E.intervals(rows, 0.2, "y", "q10", "q90").first()
    assert report["n"] == 1000 and report["n_crossed"] == 0 and abs(report["coverage"] - 0.8) <= 0.05
    width = {r["wide"]: r["w"] for r in rows.join(df.select("id", "x"), "id").groupBy((F.col("x") > 5).alias("wide")).agg(F.avg(F.col("q90") - F.col("q10")).alias("w")).collect()}
    assert width[True] > 1.5 * width[False]
    leaf = forest.leaves.where("tree = 0").count()
    assert 2 <= leaf <= 32


@pytest.mark.parametrize("bins", [1, 7, 64])
def test_leaf_quantiles_are_exact_and_move_the_asked_bins_only(spark, bins):
    """The quantiles of each (tree, leaf) for any number of bins; ties, infinities and a leaf of one row among them."""
    rng = np.random.default_rng(bins)
    y = np.concatenate((rng.normal(size=900).round(2), np.full(98, 0.5), [np.inf, -np.inf]))
    rows = [(float(v), [int(i % 3), int(abs(v) < 1), int(i == 5)]) for i, v in enumerate(y)]
    fallen = spark.createDataFrame(rows, "__y double, __at array<int>").repartition(3)
    got = {(r["tree"], r["leaf"]): (r["a"], r["b"], r["c"]) for r in Q.leaf_quantiles(fallen, {"a": 0.1, "b": 0.5, "c": 0.9}, bins).collect()}
    expected = {}
    for tree in range(3):
        for leaf in {r[1][tree] for r in rows}:
            expected[tree, leaf] = tuple(np.quantile([r[0] for r in rows if r[1][tree] == leaf], [0.1, 0.5, 0.9]))
    assert set(got) == set(expected) and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_forest_predicts_the_mean_of_its_leaves_without_a_row_for_each_tree(spark):
    rng = np.random.default_rng(4)
    rows = [(i // 2, float(a), float(a + 0.1 * e)) for i, (a, e) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, y double")
    forest = Q.fit(df, ["a"], "y", trees=4, depth=3)
    out = forest.predict(df, ["id"])
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    leaves = {(r["tree"], r["leaf"]): r for r in forest.leaves.collect()}
    found: dict = {}
    for r in Q._leaves(forest.model, df, ["a"], ["id"]).collect():
        found.setdefault(r["id"], []).extend(leaves[k]["q50"] for k in enumerate(r["__at"]))
    got = {r["id"]: r["q50"] for r in out.collect()}
    assert len(got) == 200 and all(got[i] == pytest.approx(np.mean(v)) and len(v) == 8 for i, v in found.items())
