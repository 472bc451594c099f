"""Models of the orders' priority, and scoring with them."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plumbline.catalog.evaluation import _round
from plumbline.catalog.registry import query
from plumbline.catalog.trips import KEPT_SQL, kept, scored
from plumbline.operators import evaluation as E
from plumbline.operators import models as M
from plumbline.operators import profile as P
from plumbline.operators import search as Q
from plumbline.operators import splits as S
from plumbline.session import durable, shared_folder

NUMERIC, CATEGORICAL = ["price", "score"], ["segment", "region"]


def rows(t):
    return scored(t).withColumn("label", F.col("label").cast("double"))


_PENALTY = 25.0


@query("mdl1_ridge", "MDL-1", f"WITH {KEPT_SQL}, m AS (SELECT covar_pop(fare, distance) / (var_pop(distance) + {_PENALTY}) AS slope, avg(fare) AS y, avg(distance) AS x FROM kept) SELECT round(any_value(slope), 4) AS slope, round(any_value(y - slope * x), 4) AS intercept, round(1 - avg((fare - (y - slope * x) - slope * distance) ** 2) / var_pop(fare), 6) AS r2 FROM kept, m")
def _(t):
    rows = durable(kept(t).select("distance", "fare"))
    m = M.ridge(rows, ["distance"], "fare", _PENALTY)
    r2 = 1 - F.avg(F.pow(F.col("fare") - m.predict(), 2)) / F.var_pop("fare")
    return rows.agg(F.round(F.lit(m.coefficients[0]), 4).alias("slope"), F.round(F.lit(m.intercept), 4).alias("intercept"), F.round(r2, 6).alias("r2"))


def _parts(t):
    return durable(S.stratified(rows(t), "id", "label", 0.2))


def _scored_once(t, *families):
    """Each family fitted on the training rows and judged once on the others."""
    parts, out = _parts(t), None
    for name in families:
        model = M.fitted(M.pipeline(name, NUMERIC, CATEGORICAL), parts.where("part = 'train'").select("label", *NUMERIC, *CATEGORICAL))
        p = M.scores(model, parts.where("part = 'test'"), "p").select(F.lit(name).alias("family"), "id", "label", "p")
        out = p if out is None else out.unionByName(p)
    return out


@query("mdl1_logistic", "MDL-1 UDF-3")
def _(t):
    return _scored_once(t, "logistic").select("id", "label", "p")


@query("mdl2_forest", "MDL-2 MDL-18")
def _(t):
    model = M.fitted(M.pipeline("forest", NUMERIC, CATEGORICAL), _parts(t).where("part = 'train'").select("label", *NUMERIC, *CATEGORICAL))
    weights = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    return t.spark.range(1).select(F.posexplode(F.array(*[F.lit(w) for w in weights])).alias("feature", "importance"))


@query("mdl3_boosting", "MDL-3")
def _(t):
    return _scored_once(t, "boosting").select("id", "label", "p")


@query("mdl15_holdout", "MDL-15")
def _(t):
    """Of each family the metrics on the rows that none has seen."""
    found = durable(_scored_once(t, "logistic", "forest", "boosting"))
    out = None
    for name in ("logistic", "forest", "boosting"):
        one = E.ranking_metrics(E.score_table(found.where(F.col("family") == name), score="p")).select(F.lit(name).alias("family"), "n_pos", "n_neg", "roc_auc", "average_precision")
        out = one if out is None else out.unionByName(one)
    return out


@query("mdl17_saved_model", "MDL-17 STR-1")
def _(t):
    """A pipeline that was saved and read again scores raw rows as the one that was fitted: no row differs."""
    import uuid

    parts = _parts(t)
    model = M.pipeline("logistic", NUMERIC, CATEGORICAL).fit(parts.where("part = 'train'"))
    path = f"{shared_folder(t.spark)}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    test = parts.where("part = 'test'").drop("part")
    one = M.scores(model, test, "fitted").select("id", "fitted")
    two = M.scores(PipelineModel.load(path), test, "loaded").select("id", "loaded")
    return one.join(two, "id").select("id", "fitted", "loaded", (F.col("fitted") == F.col("loaded")).alias("same"))


def _oof(t):
    folds = S.folds(rows(t), "id", "label", 3)
    return M.out_of_fold(folds, {"logistic": lambda: M.pipeline("logistic", NUMERIC, CATEGORICAL), "boosting": lambda: M.pipeline("boosting", NUMERIC, maxIter=4)})


_BASE = ["p_logistic", "p_boosting"]


@query("mdl9_out_of_fold", "MDL-9")
def _(t):
    return _oof(t).select("id", "label", *_BASE)


@query("mdl13_correlation", "MDL-13")
def _(t):
    oof = _oof(t)
    both = P.pearson(oof, _BASE).withColumnRenamed("r", "pearson")
    return both.join(P.spearman(oof, "id", _BASE).withColumnRenamed("r", "spearman"), ["a", "b"])


@query("mdl12_stacking", "MDL-12 MDL-11")
def _(t):
    """A logistic model of the base scores, judged on folds that neither level has seen, beside the even blend."""
    make = lambda: Pipeline(stages=[VectorAssembler(inputCols=_BASE, outputCol="f"), LogisticRegression(featuresCol="f", labelCol="label")])
    stacked = M.cross_fitted(_oof(t), make, lambda m, df: M.scores(m, df, "stacked"))
    return M.blended(stacked, {c: 0.5 for c in _BASE}, "blend").select("id", "label", "blend", "stacked")


def _distilled(t):
    return M.distilled(_oof(t), ["price", "score"], "p_boosting", 0.4)


@query("mdl14_distillation", "MDL-14 SCR-6")
def _(t):
    """A champion's decisions out of fold, and a shallow tree's that saw neither the row nor its score."""
    return _distilled(t).select("id", "decision", "repeated", "p_tree")


@query("mdl14_fidelity", "MDL-14 SCR-6")
def _(t):
    return M.fidelity(_distilled(t), "label", "p_boosting")


@query("mdl14_rules", "MDL-14")
def _(t):
    work = _oof(t).withColumn("decision", (F.col("p_boosting") >= 0.4).cast("double"))
    found = M.tree_rules(M.fitted(M.shallow_tree(["price", "score"]), work), ["price", "score"])
    return t.spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "rule bigint, conditions string, decision double, n double")


def _families():
    return {
        "logistic": Q.Family(lambda **p: M.pipeline("logistic", NUMERIC, CATEGORICAL, **p), {"regParam": 0.1}, {"regParam": [0.001, 0.1], "elasticNetParam": [0.0, 0.5]}),
        "tree": Q.Family(lambda **p: M.pipeline("forest", NUMERIC, **p), {"numTrees": 5, "maxDepth": 2}, {"maxDepth": [2, 4], "minInstancesPerNode": [0]})}


def _searched(t):
    parts = _parts(t)
    train = durable(S.folds(parts.where("part = 'train'").drop("part"), "id", "label", 2))
    return Q.search(train, _families(), folds=2, max_trials=4, patience=1), train, parts.where("part = 'test'")


@query("mdl5_search", "MDL-5")
def _(t):
    return _searched(t)[0]


@query("mdl5_leaderboard", "MDL-5")
def _(t):
    ledger, train, test = _searched(t)
    return Q.leaderboard(ledger, train, test, _families())


@query("exp2_partial_dependence", "EXP-2")
def _(t):
    model = M.pipeline("logistic", ["price", "score"]).fit(rows(t))
    return M.partial_dependence(model, rows(t), "price", [20000 * i for i in range(1, 25)])


@query("exp5_linear_attribution", "EXP-4 EXP-5", f"""WITH {KEPT_SQL}, m AS (SELECT avg(distance) AS a, avg(duration) AS b FROM kept)
SELECT l_orderkey, l_linenumber, l_partkey, 'distance' AS feature, round(1500 * (distance - a), 4) + 0.0 AS share FROM kept, m UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'duration', round(2 * (duration - b), 4) + 0.0 FROM kept, m""")
def _(t):
    k = kept(t).withColumn("key", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    a, b = k.agg(F.avg("distance"), F.avg("duration")).first()
    out = M.linear_attributions(k, {"distance": 1500.0, "duration": 2.0}, {"distance": a, "duration": b}, "key")
    return out.select("key.*", "feature", (F.round("share", 4) + 0.0).alias("share"))


@query("scr1_trip_scoring", "SCR-1 SCR-3", f"WITH {KEPT_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(1.0::DOUBLE, 10 + 3 * coalesce(nullif(distance, 45), 20)), 4) AS duration_hat, round(coalesce(nullif(distance, 45), 20) / greatest(1.0::DOUBLE, 10 + 3 * coalesce(nullif(distance, 45), 20)), 6) AS speed FROM kept")
def _(t):
    d = F.coalesce(F.nullif("distance", F.lit(45.0)), F.lit(20.0))
    k = kept(t).withColumn("d", d).withColumn("duration_hat", F.greatest(F.lit(1.0), 10 + 3 * F.col("d")))
    return _round(k.select("l_orderkey", "l_linenumber", "l_partkey", "duration_hat", M.implied_speed(F.col("d"), F.col("duration_hat")).alias("speed")), 6)


@query("scr2_hour_sweep", "SCR-2 SCR-5 SEG-21", f"WITH {KEPT_SQL} SELECT pickup_borough, h.hour, round(avg(fare) * (1 + h.hour / 100.0::DOUBLE), 4) AS fare FROM kept, range(24) h(hour) GROUP BY 1, 2")
def _(t):
    base = kept(t).groupBy("pickup_borough").agg(F.avg("fare").alias("base"))
    out = M.sweep(base.withColumn("hour", F.lit(0).cast("bigint")), "hour", list(range(24)), lambda df: df.withColumn("fare", F.round(F.col("base") * (1 + F.col("hour") / 100.0), 4)))
    return out.select("pickup_borough", F.col("hour").cast("bigint").alias("hour"), "fare")


@query("mdl10_greedy_ensemble", "MDL-10 UDF-2")
def _(t):
    oof = _oof(t)
    weights, path = M.greedy_ensemble(oof.select("label", *_BASE), _BASE, rounds=6)
    return M.blended(oof, weights, "blend").select("id", "blend", F.lit(path[-1]).alias("metric"))


@query("exp1_permutation_importance", "EXP-1")
def _(t):
    df = rows(t).select("id", "label", F.col("price").alias("a"), F.col("score").alias("b"))
    return M.permutation_importance(M.pipeline("logistic", ["a", "b"]).fit(df), df, ["a", "b"], "id")
