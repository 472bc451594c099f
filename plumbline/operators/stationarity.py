"""Unit-root and stationarity tests of one long, gap-free series, from aggregates over all its points."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.series import autocorrelation
from plumbline.plans import ordering
from plumbline.session import durable

#: Response surfaces of the critical values of the Dickey-Fuller statistic with a constant, by level: b0 + b1 / n + b2 / n^2 + b3 / n^3.
ADF_CRITICAL = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.04), 0.1: (-2.56677, -1.5384, -2.809, 0.0)}
#: Critical values of the KPSS statistic around a level.
KPSS_CRITICAL = {0.1: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}


def _between(statistic: float, points: Sequence[tuple[float, float]]) -> float:
    """The level at a statistic, linear between (critical value, level) pairs and no further than their ends."""
    points = sorted(points)
    if statistic <= points[0][0]:
        return points[0][1]
    for (a, p), (b, q) in zip(points, points[1:]):
        if statistic <= b:
            return p + (q - p) * (statistic - a) / (b - a)
    return points[-1][1]


def default_lags(n: int) -> int:
    """The usual number of lags for a series of n points."""
    return floor(12 * (n / 100) ** 0.25)


def dickey_fuller(df: DataFrame, order: str, value: str, lags: int | None = None) -> dict:
    """The augmented Dickey-Fuller test with a constant: statistic, lags, n, p_value, rejects (a unit root, at 5 %).

    ``order`` is consecutive whole numbers.  Each point goes to the rows that need it, so no row
    order is relied on; the regression solves normal equations that tasks add up.
    """
    n = df.where(F.col(value).isNotNull()).count()
    p = default_lags(n) if lags is None else lags
    if n < 2 * p + 10:
        raise ValueError(f"{n} points are too few for {p} lags")
    spread = df.select(F.col(value).cast("double").alias("y"), F.posexplode(F.sequence(F.col(order), F.col(order) + p + 1)).alias("k", "i")).where("y IS NOT NULL")
    rows = spread.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "y"))), lambda s: s["y"]).alias("y")).where(F.size("y") == p + 2)
    # y is the value now, one before, and so on.
    step = lambda k: F.col("y")[k] - F.col("y")[k + 1]
    x = durable(rows.select(step(0).alias("d"), F.array(F.col("y")[1], *[step(k) for k in range(1, p + 1)]).alias("x")))
    model = LinearRegression(featuresCol="f", labelCol="d", solver="normal", regParam=0.0).fit(x.withColumn("f", array_to_vector("x")))
    m, statistic = x.count(), float(model.summary.tValues[0])
    critical = {q: sum(b / m**i for i, b in enumerate(c)) for q, c in ADF_CRITICAL.items()}
    return {"statistic": statistic, "lags": p, "n": m, "p_value": _between(statistic, [(c, q) for q, c in critical.items()]), "rejects": statistic < critical[0.05]}


def kpss(df: DataFrame, order: str, value: str, lags: int | None = None) -> dict:
    """The KPSS test around a level: statistic, lags, n, p_value, rejects (stationarity, at 5 %).

    The long-run variance weighs the autocovariances by 1 - k / (lags + 1).
    """
    rows = durable(df.select(F.col(order).alias("i"), F.col(value).cast("double").alias("y")).where("y IS NOT NULL"))
    n, mean, var = rows.agg(F.count("y"), F.avg("y"), F.var_pop("y")).first()
    if not n or not var:
        raise ValueError("a series without variation has no test")
    l = ceil(12 * (n / 100) ** 0.25) if lags is None else lags
    acf = {r["lag"]: r["acf"] for r in autocorrelation(rows, "i", "y", l).collect()}  # lags + 1 numbers
    long_run = var * (1 + 2 * sum((1 - k / (l + 1)) * acf.get(k, 0.0) for k in range(1, l + 1)))
    sums = ordering.cumulate(rows.withColumn("e", F.col("y") - F.lit(mean)), [F.col("i")], {"s": F.col("e")})
    statistic = sums.agg(F.sum(F.col("s") * F.col("s"))).first()[0] / n**2 / long_run
    return {"statistic": float(statistic), "lags": l, "n": n, "p_value": _between(statistic, [(c, q) for q, c in KPSS_CRITICAL.items()]), "rejects": bool(statistic > KPSS_CRITICAL[0.05])}


def stationarity(df: DataFrame, order: str, value: str, adf_lags: int | None = None, kpss_lags: int | None = None) -> DataFrame:
    """(test, statistic, lags, n, p_value, rejects) and what both together say: ``verdict``."""
    a, k = dickey_fuller(df, order, value, adf_lags), kpss(df, order, value, kpss_lags)
    verdict = {(True, False): "stationary", (False, True): "unit root", (True, True): "neither", (False, False): "undecided"}[a["rejects"], k["rejects"]]
    rows = [(name, x["statistic"], x["lags"], x["n"], x["p_value"], x["rejects"], verdict) for name, x in (("adf", a), ("kpss", k))]
    return df.sparkSession.createDataFrame(rows, "test string, statistic double, lags bigint, n bigint, p_value double, rejects boolean, verdict string")
