"""Forecasts judged by what is known when they are made: naive models, folds, and horizons.

A feature column carries in its metadata how many hours old its newest input is; columns of the
calendar carry none.  A forecast h hours ahead may only use columns at least h hours old.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import durable

AGE = "newest_input_hours"


def back(df: DataFrame, order: str, value: str, steps: Sequence[int]) -> DataFrame:
    """Adds ``lag_k``, the value k steps earlier, by one join; ``order`` is whole numbers."""
    moved = df.where(F.col(value).isNotNull()).select(F.explode(F.array(*[F.struct((F.col(order) + k).alias(order), F.lit(k).alias("k"), F.col(value).alias("v")) for k in steps])).alias("s")).select("s.*")
    wide = moved.groupBy(order).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"lag_{k}") for k in steps])
    return df.join(wide, order, "left")


def aged(column: Column, name: str, hours: int | None = None) -> Column:
    """A feature with the age of its newest input; none for what is known in advance."""
    return column.alias(name, metadata={} if hours is None else {AGE: hours})


def known(df: DataFrame, features: Sequence[str], horizon: int) -> list[str]:
    """The features that are known ``horizon`` hours ahead."""
    return [c for c in features if df.schema[c].metadata.get(AGE, horizon) >= horizon]


def feature_table(series: DataFrame, order: str, value: str) -> DataFrame:
    """(order, y, features): lags, a daily change, trailing means and the calendar, with their ages."""
    wide = back(series, order, value, [1, 2, 3, 24, 25, 48, 168])
    means = [24, 168]
    spans = series.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.posexplode(F.sequence(F.col(order) + 1, F.col(order) + max(means))).alias("k", order))
    sums = spans.groupBy(order).agg(*[F.avg(F.when(F.col("k") < m, F.col("v"))).alias(f"m{m}") for m in means])
    phase = 2 * 3.141592653589793 * (F.col(order) % 24) / 24
    return wide.join(sums, order, "left").select(
        order, F.col(value).cast("double").alias("y"),
        *[aged(F.col(f"lag_{k}").cast("double"), f"lag_{k}", k) for k in (1, 2, 3, 24, 48, 168)], aged((F.col("lag_1") - F.col("lag_25")).cast("double"), "delta_24", 1),
        *[aged(F.col(f"m{m}"), f"mean_{m}", 1) for m in means], aged(F.sin(phase), "hour_sin"), aged(F.cos(phase), "hour_cos"))


def errors(rows: DataFrame, by: Sequence[str], y: str, p: str, scale: float | None) -> DataFrame:
    """n, mae, rmse, mase (mae over ``scale``) and r2 of predictions, per group."""
    e = F.col(y) - F.col(p)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("_m"), F.var_pop(y).alias("_v"))
    mase = F.col("mae") / F.lit(scale) if scale else F.lit(None).cast("double")
    return out.select(*by, "n", "mae", "rmse", mase.alias("mase"), F.when(F.col("_v") > 0, 1 - F.col("_m") / F.col("_v")).alias("r2"))


def seasonal_scale(series: DataFrame, order: str, value: str, cut: int, period: int) -> float | None:
    """The mean absolute change over a period up to ``cut``, which errors are measured by."""
    rows = back(series, order, value, [period]).where(F.col(order) <= cut)
    return rows.agg(F.avg(F.abs(F.col(value) - F.col(f"lag_{period}")))).first()[0]


def naive_forecasts(series: DataFrame, order: str, value: str, cut: int) -> DataFrame:
    """(order, y, model, p) after ``cut`` for: mean and hour (means of what is up to the cut), last (t - 1), day (t - 24), week (t - 168)."""
    wide = durable(back(series, order, value, [1, 24, 168]).withColumn("hour", F.col(order) % 24))
    past = wide.where(F.col(order) <= cut)
    mean = past.agg(F.avg(value)).first()[0]
    hours = past.groupBy("hour").agg(F.avg(value).alias("by_hour"))  # 24 rows
    rows = wide.where((F.col(order) > cut) & F.col(value).isNotNull()).join(F.broadcast(hours), "hour", "left")
    models = {"mean": F.lit(mean), "hour": F.coalesce("by_hour", F.lit(mean)), "last": F.col("lag_1"), "day": F.col("lag_24"), "week": F.col("lag_168")}
    cells = F.array(*[F.struct(F.lit(m).alias("model"), p.cast("double").alias("p")) for m, p in models.items()])
    return rows.select(order, F.col(value).cast("double").alias("y"), F.inline(cells)).where("p IS NOT NULL")


def horizon_naive(series: DataFrame, order: str, value: str, horizons: Sequence[int], cut: int, period: int = 24) -> DataFrame:
    """(horizon, model, n, mae) after ``cut``: the last known value, and the newest known of the same phase."""
    lags = sorted({h for h in horizons} | {-(-h // period) * period for h in horizons})
    wide = back(series, order, value, lags).where((F.col(order) > cut) & F.col(value).isNotNull())
    cells = [F.struct(F.lit(h).cast("bigint").alias("horizon"), F.lit(m).alias("model"), F.col(f"lag_{k}").cast("double").alias("p")) for h in horizons for m, k in (("last", h), ("season", -(-h // period) * period))]
    rows = wide.select(F.col(value).alias("y"), F.inline(F.array(*cells))).where("p IS NOT NULL")
    return rows.groupBy("horizon", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))


def horizon_study(table: DataFrame, order: str, features: Sequence[str], horizons: Sequence[int], cut: int, scale: float | None = None, penalty: float = 0.01) -> DataFrame:
    """(horizon, features, n, mae, rmse, mase, r2): a linear model refitted for each horizon on what is known by then.

    All horizons are judged on the same rows, those after ``cut`` that have every feature.
    """
    rows = durable(table.dropna(subset=["y", *features]))
    for h in horizons:
        if not known(table, features, h):
            raise ValueError(f"no feature is known {h} hours ahead")
    out = None
    for h in horizons:
        used = known(table, features, h)
        assembled = VectorAssembler(inputCols=used, outputCol="f").transform(rows)
        model = LinearRegression(featuresCol="f", labelCol="y", regParam=penalty, elasticNetParam=0.0, solver="normal").fit(assembled.where(F.col(order) <= cut))
        scored = model.transform(assembled.where(F.col(order) > cut)).withColumn("p", F.greatest("prediction", F.lit(0.0)))
        found = errors(scored.select(F.lit(h).cast("bigint").alias("horizon"), F.lit(",".join(used)).alias("features"), "y", "p"), ["horizon", "features"], "y", "p", scale)
        out = found if out is None else out.unionByName(found)
    return out
