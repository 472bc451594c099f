"""Detectors on planted outliers, against brute force and their own definitions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import outliers as O


@pytest.fixture(scope="module")
def planted(spark):
    """900 rows of a skewed cloud and 30 far ones (ids from 900), with a null and a NaN row."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(900, 3)) @ np.array([[1, 0.6, 0], [0, 1, 0], [0, 0, 0.3]]), rng.uniform(5, 9, (30, 3)) * rng.choice([-1, 1], (30, 3))])
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(2000, None, 1.0, 1.0), (2001, float("nan"), 1.0, 1.0)]
    return x, spark.createDataFrame(rows, "id bigint, a double, b double, c double").repartition(3)


def auc(score, bad):
    order = np.argsort(np.argsort(score))
    n, m = bad.sum(), (~bad).sum()
    return (order[bad].sum() - n * (n - 1) / 2) / (n * m)


def test_isolation_forest(spark, planted, tmp_path):
    x, df = planted
    forest = O.IsolationForest.fit(df, "id", ["a", "b", "c"], trees=60, sample=256)
    forest.save(str(tmp_path / "forest"))
    again = O.IsolationForest.load(spark, str(tmp_path / "forest"), ["a", "b", "c"])
    got = {r["id"]: (r["path"], r["score"]) for r in again.scored(df, "id").collect()}
    assert got[2000] == (None, None) and got[2001] == (None, None)
    # Every row walked by hand through the node table.
    nodes: dict = {}
    for r in forest.nodes.collect():
        nodes.setdefault(r["tree"], {})[r["node"]] = r
    assert len(nodes) == 60 and all(t[0]["size"] == 256 for t in nodes.values())
    c = lambda n: 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + O.EULER) - 2 * (n - 1) / n
    for i in range(0, 930, 31):
        depth = 0.0
        for tree in nodes.values():
            at = tree[0]
            while at["feature"] is not None:
                at = tree[at["left"] + int(x[i]["abc".index(at["feature"])] >= at["threshold"])]
            depth += at["depth"] + c(at["size"])
        assert abs(got[i][0] - depth / 60) < 1e-9 and abs(got[i][1] - 2 ** (-depth / 60 / c(256))) < 1e-9
    assert auc(np.array([got[i][1] for i in range(930)]), np.arange(930) >= 900) >= 0.95


def test_forest_is_the_same_for_any_partitioning(planted):
    _, df = planted
    one, two = (sorted(map(tuple, O.IsolationForest.fit(d, "id", ["a", "b"], trees=4, sample=64).nodes.collect()), key=repr) for d in (df, df.repartition(7)))
    assert one == two


def test_forest_of_equal_rows_or_of_few(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(20)], "id bigint, a double")
    forest = O.IsolationForest.fit(df, "id", ["a"], trees=3, sample=8)
    assert {r["score"] for r in forest.scored(df, "id").collect()} == {0.5}  # one leaf each, of the average depth
    alone = O.IsolationForest.fit(df.limit(1), "id", ["a"], trees=3)
    assert alone.scored(df.limit(1), "id").first()["score"] == 0.5
    none = O.IsolationForest.fit(df.limit(0), "id", ["a"], trees=3)
    assert none.scored(df.limit(0), "id").collect() == []


def test_one_class(planted):
    _, df = planted
    shifted = df.withColumns({c: F.col(c) + 6 for c in "abc"})
    model = O.one_class(shifted, ["a", "b", "c"], 0.1)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) > 2
    flags = shifted.where("id < 1000").agg(F.avg((model.score() > 0).cast("double"))).first()[0]
    assert abs(flags - 0.1) <= 0.01
    other = O.one_class(shifted.repartition(9), ["a", "b", "c"], 0.1)
    assert other.weights == model.weights and other.offset == model.offset


def test_envelope(planted):
    x, df = planted
    found = O.envelope(df, ["a", "b", "c"])
    # Brute force of the same steps.
    mean, cov = x.mean(axis=0), np.cov(x.T, bias=True)
    for _ in range(len(found.kept) - 1):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        kept = x[d <= np.quantile(d, 0.9)]
        mean, cov = kept.mean(axis=0), np.cov(kept.T, bias=True)
    assert np.allclose(found.mean, mean) and np.allclose(found.covariance, cov) and found.kept[0] == 930 and found.kept[-1] == len(kept)
    scores = {r["id"]: r["d"] for r in df.where("id < 1000").select("id", found.distance().alias("d")).collect()}
    assert auc(np.array([scores[i] for i in range(930)]), np.arange(930) >= 900) > 0.99
    with pytest.raises(O.SingularCovariance):
        O.envelope(df.withColumn("d", F.col("a") * 2 + F.col("b")), ["a", "b", "d"])
    with pytest.raises(O.SingularCovariance):
        O.envelope(df.withColumn("d", F.lit(1.0)), ["a", "d"])


def test_deviations(planted):
    x, df = planted
    got = O.flagged_deviation(df.where("id < 1000"), ["a", "b", "c"], F.col("id") >= 900, 2).collect()
    iqr = np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)
    expected = dict(zip("abc", (np.median(x[900:], axis=0) - np.median(x, axis=0)) / iqr))
    assert len(got) == 2 and all(abs(r["deviation"] - expected[r["feature"]]) < 1e-9 for r in got)
    rows = O.deviating(df.where("id < 1000"), "id", ["a", "b", "c"], 2).where("id = 905").orderBy("place").collect()
    far = dict(zip("abc", (x[905] - np.median(x, axis=0)) / np.ptp(x, axis=0)))
    assert [r["feature"] for r in rows] == sorted(far, key=lambda c: -abs(far[c]))[:2]
