"""Models judged on rows they have not seen, and the search ledger."""

from __future__ import annotations

import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import baskets as B
from plumbline.operators import decisions as D
from plumbline.operators import models as M
from plumbline.operators import reports as R
from plumbline.operators import search as Q


@pytest.fixture(scope="module")
def labelled(spark):
    """400 rows; the label follows a, not b; folds 0 to 2."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=400), rng.normal(size=400)
    y = (a + 0.5 * rng.normal(size=400) > 0).astype(float)
    rows = [(i, i % 3, float(u), float(v), float(w)) for i, (u, v, w) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "id bigint, fold bigint, a double, b double, label double").repartition(3).cache()


def test_ridge_solves_its_normal_equations(labelled):
    x = np.array([(r["a"], r["b"], r["label"]) for r in labelled.collect()])
    m = M.ridge(labelled, ["a", "b"], "label", 0.7)
    s = np.cov(x.T, bias=True)
    assert np.allclose(m.coefficients, np.linalg.solve(s[:2, :2] + 0.7 * np.eye(2), s[:2, 2]))
    assert abs(labelled.agg(F.avg(m.predict())).first()[0] - x[:, 2].mean()) < 1e-9


def test_distilled_rows_are_judged_unseen(labelled):
    scored = labelled.withColumn("score", F.when(F.col("id") % 50 == 7, 1 - F.col("label")).otherwise(F.col("label")))
    out = M.distilled(scored, ["a"], "score", 0.5)
    assert out.count() == 400 and out.where("decision = cast(score >= 0.5 as double)").count() == 400
    found = M.fidelity(out, "label", "score").first()
    assert 0.75 < found["agreement"] < 0.99 and 0.6 < found["auc_tree"] < found["auc"]
    rules = M.tree_rules(M.shallow_tree(["a", "b"], 2).fit(out), ["a", "b"])
    assert sum(r[2] for r in rules) == 400 and any("a <= " in r[0] for r in rules)


def test_importance_finds_the_feature_that_matters(labelled):
    model = M.pipeline("logistic", ["a", "b"]).fit(labelled)
    found = {r["feature"]: r for r in M.permutation_importance(model, labelled, ["a", "b"], "id", repeats=4).collect()}
    assert found["a"]["significant"] and found["a"]["mean_drop"] > 0.2 and found["a"]["std_drop"] > 0
    assert abs(found["b"]["mean_drop"]) < 0.05
    with pytest.raises(ValueError):
        M.permutation_importance(model, labelled, ["a"], "id", repeats=1)


@pytest.mark.parametrize("slice_rows", [7, 10**6])
def test_rows_before_and_precisions_do_not_depend_on_slices(spark, labelled, slice_rows):
    order = lambda r, i: M.portable_hash(F.concat(F.lit(f"{r}/"), F.col("id").cast("string"))).alias(f"h{i}")
    found = {(x["__repeat"], x["id"]): x["__new0"] for x in M._rows_before(labelled, ["a"], "id", 2, slice_rows).collect()}
    for r in range(2):
        rows = sorted(labelled.select("id", "a", order(r, 0)).collect(), key=lambda x: (x["h0"], x["id"]))
        assert [found[r, x["id"]] for x in rows] == [rows[-1]["a"], *[x["a"] for x in rows[:-1]]]
    data = [(g, float(y), None if i % 59 == 58 else float("nan") if i % 50 == 49 else -float(s)) for g in (0, 1) for i, (y, s) in enumerate(np.random.default_rng(g).random((300, 2)).round(1))]
    data = [(g, None if i % 31 == 30 else float(y > 0.6), s) for i, (g, y, s) in enumerate(data)]
    got = {x["g"]: x["ap"] for x in M._average_precisions(spark.createDataFrame(data, "g int, __y double, __s double"), ["g"], slice_rows).collect()}
    for g in (0, 1):
        rank = lambda s: (0, 0.0) if s is None else (2, 0.0) if s != s else (1, s)
        rows = [(rank(s), y) for k, y, s in data if k == g]
        total, at = sum(y == 1 for _, y in rows), 0.0
        for s, y in rows:
            if y == 1:
                tp, fp = (sum(z == w for t, z in rows if t <= s) for w in (1, 0))
                at += tp / (tp + fp)
        assert got[g] == pytest.approx(at / total)


def families(fail=True):
    def make(depth=1, twist=0):
        if twist == 9:
            raise RuntimeError("no such twist")
        return M.pipeline("forest", ["a"] if depth > 1 else ["b"], numTrees=2, maxDepth=depth)

    return {"tree": Q.Family(make, {"depth": 1}, {"depth": [1, 3], "twist": [9] if fail else []})}


def test_search_ledger_is_replayed_and_resumed(spark, labelled, tmp_path):
    path = str(tmp_path / "ledger")
    one = Q.search(labelled, families(), folds=2, path=path, patience=1)
    rows = [tuple(r) for r in one.orderBy("trial").collect()]
    assert rows[0][2] == '{"depth": 1}' and {r[3] for r in rows} == {"ok", "failed"}
    assert all("no such twist" in r[6] for r in rows if r[3] == "failed")
    best = max((r for r in rows if r[4] is not None), key=lambda r: r[4])
    assert json.loads(best[2])["depth"] == 3 and best[7]  # the planted best
    assert [tuple(r) for r in Q.search(labelled, families(), folds=2, patience=1).orderBy("trial").collect()] == rows
    # Resumed: nothing is fitted again, so a maker that always fails changes nothing.
    broken = {"tree": Q.Family(lambda **p: 1 / 0, families()["tree"].seed, families()["tree"].grid)}
    assert [tuple(r) for r in Q.search(labelled, broken, folds=2, path=path, patience=1).orderBy("trial").collect()] == rows
    board = Q.leaderboard(one, labelled.where("fold != 2"), labelled.where("fold = 2"), families()).first()
    assert board["failed"] >= 1 and board["improvement"] > 0 and board["overfit"] == (board["gap"] > 0.03)


def test_isotonic_groups(labelled):
    few = labelled.withColumn("x", F.round("a", 1))
    whole, grouped = (D.Isotonic("x", "label", "p", g).fit(few).transform(few).select("x", "label", "p").collect() for g in (2000, 10))
    for rows in (whole, grouped):
        pairs = sorted((r["x"], r["p"]) for r in rows)
        assert all(p <= q + 1e-12 for (_, p), (_, q) in zip(pairs, pairs[1:]))
    assert abs(np.mean([r["p"] for r in whole]) - np.mean([r["label"] for r in whole])) < 1e-9
    assert np.mean([abs(a["p"] - b["p"]) for a, b in zip(sorted(whole), sorted(grouped))]) < 0.1


def test_report_counts_what_it_leaves_out(spark):
    rows = [(1, 1, 0.9), (2, 0, 0.2), (3, 1, 0.6), (4, 0, 0.7), (5, 1, float("nan")), (6, 0, None), (7, None, 0.5)]
    df = spark.createDataFrame(rows, "id bigint, label bigint, score double")
    found = {(r["section"], r["item"], r["measure"]): r["value"] for r in R.classification_report(df, "id", bins=2).collect()}
    assert found["rows", "all", "rows"] == 7 and found["rows", "all", "left_out"] == 3
    assert found["ranking", "all", "roc_auc"] == 0.75 and found["threshold", "all", "precision"] == 2 / 3
    assert sum(v for (s, _, m), v in found.items() if s == "histogram" and m == "n") == 4


def test_profile_sections_and_repeated_names(spark):
    df = spark.createDataFrame([(1, 1.0, "x", None), (2, 3.0, "y", 4.0), (3, None, "x", 5.0)], "id bigint, v double, w string, u double")
    twice = df.select("*", F.col("v"))
    rows = R.full_profile(twice, "id", target="w").collect()
    found = {(r["section"], r["item"], r["measure"]): r["text"] if r["value"] is None else r["value"] for r in rows}
    assert found["shape", "all", "columns"] == 4 and found["types", "v", "type"] == "double"
    assert found["numeric", "v", "n_missing"] == 1 and found["categorical", "w", "mode"] == "x" and found["missing together", "*/*", "both"] == 2
    assert found["target", "v/numeric-by-class/separation", "value"] == 2.0
    assert {r["section"] for r in rows} >= {"pearson", "spearman", "quality", "histogram", "frequent", "missing"}


def test_long_baskets_and_long_sets(spark):
    rng = np.random.default_rng(1)
    made = [sorted(set(rng.choice(30, 6).tolist())) for _ in range(200)] + [list(range(400))] + [[1, 2, 3, 4, 5]] * 60
    rows = spark.createDataFrame([(i, [f"i{x:03d}" for x in b]) for i, b in enumerate(made)], "basket bigint, items array<string>")
    found = {tuple(r["items"]): r["n"] for r in B.frequent_itemsets(rows, 0.1, 5).collect()}
    from itertools import combinations

    expected = {}
    for size in range(1, 6):
        for s in combinations(range(30), size):
            n = sum(set(s) <= set(b) for b in made)
            if n >= 0.1 * len(made):
                expected[tuple(f"i{x:03d}" for x in s)] = n
    assert found == expected and any(len(s) == 5 for s in found)
    sets = B.frequent_itemsets(rows, 0.1, 5)
    split = {(tuple(r["antecedent"]), tuple(r["consequent"])) for r in B.rules(sets, 0.0, 0.0).collect()}
    assert split == {(tuple(a), tuple(x for x in s if x not in a)) for s in expected for k in range(1, len(s)) for a in combinations(s, k)}


def test_folds_are_fitted_at_the_same_time_and_as_one_by_one(spark):
    rows = [(i, i % 3, float(i % 7), float(i % 7 > 2)) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, fold bigint, x double, label double")
    together = threading.Barrier(3, timeout=60)

    def make():
        together.wait()
        return M.pipeline("logistic", ["x"])

    got = {r["id"]: r["p_a"] for r in M.out_of_fold(df, {"a": make}).collect()}
    crossed = M.cross_fitted(df, make, lambda m, part: M.scores(m, part, "p_a"))
    assert {r["id"]: r["p_a"] for r in crossed.collect()} == pytest.approx(got, rel=1e-6) and len(got) == 90
    for f in range(3):
        model = M.pipeline("logistic", ["x"]).fit(df.where(F.col("fold") != f))
        for r in M.scores(model, df.where(F.col("fold") == f), "p").collect():
            assert got[r["id"]] == pytest.approx(r["p"], rel=1e-6)
