"""Models on ``pyspark.ml``: families, folds, ensembles, explanation and scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.evaluation import ranking_metrics, score_table
from plumbline.operators.outliers import complete, moments
from plumbline.plans.ordering import portable_hash
from plumbline.session import durable

#: Factories from parameters to estimators; a caller may add its own.
FAMILIES: dict[str, Callable[..., Estimator]] = {
    "logistic": lambda **p: LogisticRegression(**{"regParam": 0.01, **p}),
    "forest": lambda **p: RandomForestClassifier(**{"numTrees": 20, "maxDepth": 5, "seed": 42, **p}),
    "boosting": lambda **p: GBTClassifier(**{"maxIter": 10, "maxDepth": 3, "seed": 42, **p}),
}


def pipeline(family: str, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "label", **params) -> Pipeline:
    """Preprocessing and model in one: what is saved can score raw rows."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categorical]
    hot = [OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical])] if categorical else []
    assemble = VectorAssembler(inputCols=[*numeric, *[f"{c}_v" for c in categorical]], outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[*index, *hot, assemble, FAMILIES[family](**params).setLabelCol(label).setFeaturesCol("features")])


#: Rows that one task takes of what a tree learner keeps in memory.
TASK_ROWS = 200_000


def fitted(estimator: Estimator, df: DataFrame) -> PipelineModel:
    """``estimator`` fitted to ``df``; for trees the rows are dealt over so many tasks that each has TASK_ROWS of them.

    Tree learners keep each partition's rows unpacked, many times the size of its file.
    """
    last = estimator.getStages()[-1] if isinstance(estimator, Pipeline) else estimator
    if isinstance(last, (RandomForestClassifier, GBTClassifier, DecisionTreeClassifier)):
        parts = -(-df.count() // TASK_ROWS)
        df = df.repartition(parts) if parts > 1 else df
    return estimator.fit(df)


def scores(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """``df`` with the probability of class 1."""
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], out)


#: Folds that are fitted at the same time: an iteration of a learner is a short job, which leaves cores idle.
FOLDS_AT_ONCE = 3


def _together(df: DataFrame, one: Callable[[int], DataFrame], k: int) -> DataFrame:
    """The rows of ``one(0)`` to ``one(k - 1)``, in this order; the jobs of several folds run at the same time."""
    out = None
    with ThreadPool(min(FOLDS_AT_ONCE, k)) as pool:
        tasks = [inheritable_thread_target(df.sparkSession)(partial(one, f)) for f in range(k)]
        for part in pool.imap(lambda task: task(), tasks):
            out = part if out is None else out.unionByName(part)
    return out


def out_of_fold(df: DataFrame, makers: Mapping[str, Callable[[], Estimator]], fold: str = "fold", k: int = 3) -> DataFrame:
    """``df`` with a column of scores for each model; every row is scored by a model that has not seen it.

    The folds are written before they are fitted, and the result is written too, so that nothing is fitted twice.
    """
    df = durable(df)

    def one(f: int) -> DataFrame:
        train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        for name, make in makers.items():
            test = scores(fitted(make(), train), test, f"p_{name}")
        return test

    return durable(_together(df, one, k))


@dataclass
class Ridge:
    """A linear model with a penalty on the squares of its coefficients, not on the intercept."""

    features: list[str]
    coefficients: list[float]
    intercept: float

    def predict(self) -> Column:
        return sum((F.col(c).cast("double") * w for c, w in zip(self.features, self.coefficients)), F.lit(self.intercept))


def ridge(df: DataFrame, features: Sequence[str], label: str, penalty: float) -> Ridge:
    """Solves (S + penalty I) b = s of the (population) covariances, which are one aggregate; rows with a null are left out."""
    import numpy as np

    rows = df.where(complete(df, [*features, label]))
    n, mean, cov = moments(rows, [*features, label])
    if not n:
        raise ValueError("no complete row to learn from")
    k = len(features)
    b = np.linalg.solve(cov[:k, :k] + penalty * np.eye(k), cov[:k, k])
    return Ridge(list(features), [float(v) for v in b], float(mean[k] - b @ mean[:k]))


def cross_fitted(df: DataFrame, make: Callable[[], Estimator], score: Callable[[PipelineModel, DataFrame], DataFrame], fold: str = "fold", k: int = 3) -> DataFrame:
    """``score(model, rows)`` of each fold's rows by the model that was fitted on the other folds."""
    return durable(_together(df, lambda f: score(fitted(make(), df.where(F.col(fold) != f)), df.where(F.col(fold) == f)), k))


def average_precision(df: DataFrame, label: str, score: str) -> float:
    return ranking_metrics(score_table(df, label, score)).first()["average_precision"] or 0.0


def greedy_ensemble(df: DataFrame, columns: Sequence[str], metric: Callable[[DataFrame, str, str], float] = average_precision, label: str = "label", rounds: int = 4) -> tuple[dict[str, float], list[float]]:
    """Weights by greedy addition with replacement, and the metric after each round; stops when nothing gains."""
    chosen: list[str] = []
    path: list[float] = []
    for _ in range(rounds):
        found = []
        for c in columns:
            blend = sum((F.col(x) for x in [*chosen, c]), F.lit(0.0)) / (len(chosen) + 1)
            found.append((metric(df.select(label, blend.alias("b")), label, "b"), c))
        best, name = max(found, key=lambda x: (x[0], -columns.index(x[1])))
        if path and best <= path[-1]:
            break
        chosen.append(name)
        path.append(best)
    return {c: chosen.count(c) / len(chosen) for c in columns if c in chosen}, path


def blended(df: DataFrame, weights: Mapping[str, float], out: str = "score") -> DataFrame:
    total = sum(weights.values()) or 1.0
    return df.withColumn(out, sum((F.col(c) * (w / total) for c, w in weights.items()), F.lit(0.0)))


def shallow_tree(numeric: Sequence[str], depth: int = 4, label: str = "decision") -> Pipeline:
    """A tree small enough to be read."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(numeric), outputCol="__f"),
        DecisionTreeClassifier(labelCol=label, featuresCol="__f", maxDepth=depth, seed=42)])


def distilled(df: DataFrame, numeric: Sequence[str], score: str, threshold: float, depth: int = 4, fold: str = "fold", k: int = 3) -> DataFrame:
    """``df`` with ``decision`` (of ``score`` at the threshold), ``repeated`` and ``p_tree`` of a shallow tree that has not seen the row."""
    work = durable(df.withColumn("decision", (F.col(score) >= threshold).cast("double")))

    def judged(model: PipelineModel, rows: DataFrame) -> DataFrame:
        found = model.transform(rows)
        p = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))  # a fold may have one decision only
        return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("prediction").alias("repeated"), p.alias("p_tree"))

    return cross_fitted(work, lambda: shallow_tree(numeric, depth), judged, fold, k)


def fidelity(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row about a distilled table: agreement, and the ROC-AUC of both and how much of it the tree keeps."""
    agree = df.agg(F.avg((F.col("decision") == F.col("repeated")).cast("double")).alias("agreement")).first()[0]
    auc = [ranking_metrics(score_table(df, label, c)).first()["roc_auc"] for c in (score, "p_tree")]
    kept = (auc[1] - 0.5) / (auc[0] - 0.5) if None not in auc and auc[0] != 0.5 else None
    return df.sparkSession.createDataFrame([(agree, *auc, kept)], "agreement double, auc double, auc_tree double, auc_kept double")


def tree_rules(model: PipelineModel, names: Sequence[str]) -> list[tuple[str, float, float]]:
    """(conditions, prediction, rows) of each leaf, from left to right."""
    out: list[tuple[str, float, float]] = []

    def walk(node, path):
        if node.numDescendants() == 0:
            out.append((" and ".join(path) or "always", float(node.prediction()), float(node.impurityStats().count())))
            return
        split = node.split()
        name, at = names[split.featureIndex()], split.threshold()
        walk(node.leftChild(), [*path, f"{name} <= {at:.6g}"])
        walk(node.rightChild(), [*path, f"{name} > {at:.6g}"])

    walk(model.stages[-1]._java_obj.rootNode(), [])
    return out


#: Rows of a slice of an order, about.
SLICE_ROWS = 200_000


def _rows_before(rows: DataFrame, features: Sequence[str], key: str, repeats: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each row in each ``__repeat``, with the features of the row before it in that repeat's order as ``__new0``...

    The order is by a hash of 60 bits, even over its range, so that slices of the range are even too.
    """
    slices = max(1, -(-rows.count() // slice_rows))
    hashed = portable_hash(F.concat(F.col("__repeat").cast("string"), F.lit("/"), F.col(key).cast("string")))
    laid = rows.withColumn("__repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("__hash", hashed)
    # Rows without a key are the first of the order.
    laid = laid.withColumn("__slice", F.coalesce(F.floor(F.col("__hash") / F.lit(float(1 << 60)) * slices), F.lit(-1)))
    values = F.struct(*[F.col(f).alias(f"__new{i}") for i, f in enumerate(features)])
    group = ["__repeat", "__slice"]
    order = Window.partitionBy(*group).orderBy("__hash", key)
    inside = laid.withColumn("__before", F.lag(values).over(order)).withColumn("__last", F.lead(F.lit(True)).over(order).isNull())
    inside = durable(inside.drop("__hash"))
    # A row for each slice: what the slice before it ends with, and for the first what the last does.
    lasts = inside.where("__last").select(*group, values.alias("__carry"))
    along = Window.partitionBy("__repeat").orderBy("__slice")
    ends = F.last("__carry").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lasts = lasts.select(*group, F.coalesce(F.lag("__carry").over(along), ends).alias("__carry"))
    both = inside.join(F.broadcast(lasts), group).withColumn("__from", F.coalesce("__before", "__carry"))
    return both.select("__repeat", *[F.col(f"`{c}`") for c in rows.columns], "__from.*")


def _average_precisions(scored: DataFrame, group: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(group, ap) of rows (group, __y, __s) along ``__s``, ties together.

    Slices of __s, cut alike in all groups, are totalled first; each is then ordered by itself.
    A slice of many rows, which hold few values, is counted by value before it is moved.
    """
    group = list(group)
    scored = durable(scored)
    n, s, y = scored.count(), F.col("__s"), F.col("__y")
    slices = max(1, -(-n // slice_rows))
    cuts = sorted({c for c in scored.where(~F.isnan(s)).approxQuantile("__s", [i / slices for i in range(1, slices)], 0.25 / slices)} if slices > 1 else [])
    sliced = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="__s", outputCol="__slice", handleInvalid="keep").transform(scored)
    # As Spark orders them: null first, NaN (a slice of its own) last.
    place = F.when(s.isNull(), F.lit(-1)).otherwise(F.col("__slice").cast("int"))
    sliced = sliced.select(*group, "__s", place.alias("__slice"), (y == 1).alias("__pos"), (y != 1).alias("__neg"))
    group_slice = [*group, "__slice"]
    totals = sliced.groupBy(*group_slice).agg(F.count(F.lit(1)).alias("rows"), F.count_if("__pos").alias("tp"), F.count_if("__neg").alias("fp"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = durable(totals.select(*group_slice, "rows", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("tp", "fp")]))
    marked = sliced.join(F.broadcast(totals), group_slice)
    heavy = F.col("rows") > 4 * slice_rows
    one = marked.where(~heavy).select(*group_slice, "tp0", "fp0", "__s", F.coalesce(F.col("__pos").cast("bigint"), F.lit(0)).alias("pos"), F.coalesce(F.col("__neg").cast("bigint"), F.lit(0)).alias("neg"))
    two = marked.where(heavy).groupBy(*group_slice, "tp0", "fp0", "__s").agg(F.count_if("__pos").alias("pos"), F.count_if("__neg").alias("neg"))
    along = Window.partitionBy(*group_slice).orderBy("__s")  # a range, so rows of one value have the same sums
    sums = one.unionByName(two).select(*group, "pos", *[(F.col(f"{c}0") + F.sum(x).over(along)).alias(c) for c, x in (("tp", "pos"), ("fp", "neg"))])
    return sums.groupBy(*group).agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("ap"))


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str, label: str = "label", repeats: int = 8) -> DataFrame:
    """(feature, mean_drop, std_drop, significant): the loss of average precision when a feature's values are dealt anew.

    In each repeat the rows stand in another seeded order, over all rows, and a row takes the value
    of the row before it, the first that of the last.  All features and repeats are scored in one
    pass.  Significant is a mean drop over two standard deviations of the repeats.
    """
    if repeats < 2:
        raise ValueError("a deviation needs two repeats at least")
    rows = durable(df)  # the model may need columns that are not dealt anew
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in features]
    both = _rows_before(rows, features, key, repeats)
    swaps = F.array(*[F.struct(F.lit(i).alias("__case"), *[(F.col(f"__new{j}") if i == j else F.col(f)).alias(f"__v{j}") for j, f in enumerate(features)]) for i in range(len(features))])
    cases = both.select("__repeat", *rest, F.inline(swaps)).select("__repeat", "__case", *rest, *[F.col(f"__v{j}").alias(f) for j, f in enumerate(features)])
    whole = rows.select(F.lit(-1).alias("__repeat"), F.lit(-1).alias("__case"), *rest, *features)
    scored = scores(model, cases.unionByName(whole)).select("__repeat", "__case", F.col(label).alias("__y"), (-F.col("score")).alias("__s"))
    found = _average_precisions(scored, ["__repeat", "__case"]).collect()  # a row for each case
    base = next((r["ap"] for r in found if r["__case"] == -1), None) or 0.0
    out = []
    for i, f in enumerate(features):
        drops = [base - (r["ap"] or 0.0) for r in found if r["__case"] == i]
        mean = sum(drops) / max(1, len(drops))
        std = (sum((d - mean) ** 2 for d in drops) / max(1, len(drops))) ** 0.5
        out.append((f, float(mean), float(std), bool(mean > 2 * std and mean > 0)))
    return df.sparkSession.createDataFrame(out, "feature string, mean_drop double, std_drop double, significant boolean")


def partial_dependence(model: PipelineModel, df: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    """(value, mean_score) over all rows, with the feature set to each value of a fixed grid; one job."""
    laid = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return scores(model, laid).groupBy(F.col(feature).alias("value")).agg(F.avg("score").alias("mean_score"))


def linear_attributions(df: DataFrame, weights: Mapping[str, float], means: Mapping[str, float], key: str) -> DataFrame:
    """(key, feature, value, share): the exact parts, weight * (x - mean), of a linear model's score."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), ((F.col(c) - means[c]) * w).alias("share")) for c, w in weights.items()])
    return df.select(key, F.inline(parts))


def sweep(df: DataFrame, field: str, values: Sequence, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each row scored with the field at every value of a fixed list."""
    return score(df.drop(field).withColumn(field, F.explode(F.array(*[F.lit(v) for v in values]))))


def implied_speed(distance: Column, duration: Column) -> Column:
    return distance / F.greatest(duration, F.lit(1.0))
