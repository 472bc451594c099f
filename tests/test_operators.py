"""Properties of operators that have no oracle, and errors that must be raised."""

from __future__ import annotations

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from plumbline.operators import evaluation, features, models, profile, segments, series, splits


def test_permutations_and_persistence(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("label"), ((F.col("id") % 2) * 2.0 + F.col("id") % 7 / 10.0).alias("a"), (F.col("id") * 37 % 11).cast("double").alias("b"), F.concat(F.lit("k"), F.col("id") % 3).alias("k"))
    model = models.pipeline("logistic", ["a", "b"], ["k"]).fit(df)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert models.scores(again, df).exceptAll(models.scores(model, df)).isEmpty()
    found = {r["feature"]: r["mean_drop"] for r in models.permutation_importance(model, df, ["a", "b"], "id").collect()}
    assert found["a"] > 0.2 > abs(found["b"])


def test_transformers_save_and_load(spark, tmp_path):
    train = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), (None, None)], "k string, v double")
    test = spark.createDataFrame([("a", 2.0), ("z", None), (None, 9.0)], "k string, v double")
    made = [features.fit_frequency(train, "k"), features.fit_rare(train, "k", 0.5), features.fit_mode(train, "k"), features.fit_one_hot(train, "k"), features.fit_columns(train, "median", ["v"]), features.fit_columns(train, "standard", ["v"])]
    for i, f in enumerate(made):
        f.save(str(tmp_path / str(i)))
        g = features.Fitted.load(spark, str(tmp_path / str(i)))
        assert sorted(map(repr, f.transform(test).collect())) == sorted(map(repr, g.transform(test).collect()))
    assert {r["k"]: r["k_freq"] for r in made[0].transform(test).collect()} == {"a": 0.5, "z": 0.0, None: 0.25}
    assert {r["k"] for r in made[1].transform(test).collect()} == {"a", "__rare__"}


def test_splits_do_not_leak(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), (F.col("id") % 37).alias("g"), F.col("id").alias("ts"))
    part = splits.stratified(df, "id", "label", 0.2)
    assert {(r["label"], r["part"]): r["count"] for r in part.groupBy("label", "part").count().collect()} == {(0, "test"): 180, (0, "train"): 720, (1, "test"): 20, (1, "train"): 80}
    splits.require_disjoint(part, "id")
    with pytest.raises(ValueError):
        splits.require_disjoint(part, "g")
    assert splits.shared_keys(splits.by_group(df, "g", 0.2), "g").isEmpty()
    assert splits.is_chronological(splits.chronological(df, [F.col("ts")], 0.2), "ts") and not splits.is_chronological(part, "ts")
    with pytest.raises(ValueError):
        splits.purged_folds(df, [F.col("ts")], 4, 150, 60)
    with pytest.raises(ValueError):
        splits.require_absent(["a", "label"], ["label"])


def test_clusters(spark):
    rows = [(i, c, [c * 10.0 + i % 3, float(i % 5)]) for i in range(60) for c in (0, 1)]
    df = spark.createDataFrame(rows, "id int, cluster int, x array<double>")
    assert segments.silhouettes(df).agg(F.min("silhouette")).first()[0] > 0.5
    found = segments.separation(df)
    assert found["davies_bouldin"] < 0.6 and found["calinski_harabasz"] > 300
    assert segments.adjusted_rand(df, "cluster", "cluster").first()["ari"] == pytest.approx(1.0)


def test_partial_autocorrelation_of_an_autoregression():
    got = series.partial_autocorrelation([0.6**k for k in range(6)])
    assert got[:2] == pytest.approx([1.0, 0.6]) and got[2:] == pytest.approx([0.0] * 4, abs=1e-12)


def test_perfect_and_inverted_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.3), (0, 0.1)], "label int, score double")
    good = evaluation.ranking_metrics(evaluation.score_table(df)).first()
    bad = evaluation.ranking_metrics(evaluation.score_table(df.withColumn("score", -F.col("score")))).first()
    assert (good["roc_auc"], good["average_precision"], bad["roc_auc"], bad["inverted"]) == (1.0, 1.0, 0.0, True)
    with pytest.raises(ValueError):
        evaluation.conformal_adjustment(df.select(F.col("score").alias("y"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), 0.1)


def test_scorecard_needs_its_key(spark):
    with pytest.raises(ValueError):
        profile.scorecard(spark.range(3).toDF("a"), ["b"], {}, "a", [])


def test_scores_that_are_not_numbers_count_nowhere(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, float("nan")), (0, float("nan")), (1, None), (None, 0.5)], "label int, score double")
    assert tuple(evaluation.confusion(df, 0.5).first()) == (1, 0, 1, 0)
    assert evaluation.totals(evaluation.score_table(df)) == (1, 1)


def test_equal_baskets_are_looked_at_once(spark):
    """Completions of baskets that come as several rows, and null baskets, which have items but no pairs."""
    from plumbline.operators import baskets as B

    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["a"]), (3, ["c"]), (None, ["a", "b"])], "basket bigint, items array<string>")
    assert {(r["items"], r["rows"]) for r in B.kinds(rows).selectExpr("array_join(items, '') AS items", "rows").collect()} == {("ab", 3), ("a", 1), ("c", 1)}
    sets = {"".join(r["items"]): r["n"] for r in B.frequent_itemsets(rows, 0.2).collect()}
    assert sets == {"a": 4, "b": 3, "c": 1, "ab": 2}
    rules = spark.createDataFrame([(["a"], ["b", "d"], 2.0), (["c"], ["b"], 3.0), (["c"], ["e"], 1.0)], "antecedent array<string>, consequent array<string>, lift double")
    got = {(r["basket"], r["item"], r["lift"]) for r in B.completions(rows, rules, 2).collect()}
    assert got == {(1, "d", 2.0), (2, "d", 2.0), (None, "d", 2.0), (3, "b", 3.0), (3, "d", 2.0)}


def test_silhouettes_of_many_clusters_keep_the_plan_small(spark):
    from plumbline.operators import segments as S

    rows = spark.range(400).selectExpr("id", "id DIV 2 AS cluster", "array(double(id DIV 2 * 10 + id % 2), 0D) AS x")
    found = S.silhouettes(rows)
    assert len(found._jdf.queryExecution().analyzed().toString()) < 20_000
    assert all(abs(r["silhouette"] - (1 - 1 / 90.5)) < 0.02 for r in found.collect())


def test_tree_rows_are_dealt(spark, monkeypatch):
    from plumbline.operators import models as M

    rows = spark.range(100).selectExpr("double(id % 2) AS label", "double(id) AS x").coalesce(1)
    seen = []

    class Probe(M.Pipeline):
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())

    monkeypatch.setattr(M, "TASK_ROWS", 30)
    for family in ("forest", "logistic"):
        M.fitted(Probe(stages=M.pipeline(family, ["x"]).getStages()), rows)
    assert seen == [4, 1]


def test_both_algorithms_are_compared_on_sets_of_any_length(spark, tmp_path):
    from plumbline import catalog

    catalog.load()
    kinds = ["large", "small", "economy", "promo", "standard"]
    spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "p_partkey bigint, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    # Orders of all five, of one, and of the first two.
    lines = [(o, i, 1.0) for o in range(20) for i in range(5)] + [(o, 0, 1.0) for o in range(20, 30)] + [(o, i, 1.0) for o in range(30, 60) for i in range(2)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.QUERIES["set3_set_equality"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(31, 31, 0, 0, 0, True)]
