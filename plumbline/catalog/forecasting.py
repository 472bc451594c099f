"""Hourly counts: stationarity, naive models, folds, horizons; quantile bands of the trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.evaluation import _round
from plumbline.catalog.registry import query
from plumbline.catalog.trips import kept
from plumbline.operators import evaluation as E
from plumbline.operators import horizons as H
from plumbline.operators import quantile_forest as Q
from plumbline.operators import series as S
from plumbline.operators import stationarity as T
from plumbline.session import durable

_SERIES = """g AS (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS hour FROM events), c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT epoch(g.hour)::BIGINT // 3600 AS i, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.hour = c.hour), cut AS (SELECT min(i) + (max(i) - min(i)) * 4 // 5 AS cut FROM s)"""


def series(t):
    """(i, n): events of every hour, hours numbered, none missing."""
    grid = S.hourly(t.events, "ts", {"n": F.count(F.lit(1))})
    return durable(grid.select((F.unix_timestamp(F.col("hour").cast("timestamp")) / 3600).cast("bigint").alias("i"), F.coalesce("n", F.lit(0)).alias("n")))


def _cut(s) -> int:
    lo, hi = s.agg(F.min("i"), F.max("i")).first()
    return lo + (hi - lo) * 4 // 5


@query("ts10_stationarity", "TS-10", f"""WITH {_SERIES}, r AS (SELECT a.n - b.n AS d, b.n AS x, b.n - c.n AS z FROM s a JOIN s b ON b.i = a.i - 1 JOIN s c ON c.i = a.i - 2),
v AS (SELECT count(*) AS m, var_pop(d) AS vd, var_pop(x) AS vx, var_pop(z) AS vz, covar_pop(x, z) AS cxz, covar_pop(x, d) AS cxd, covar_pop(z, d) AS czd FROM r),
b AS (SELECT *, vx * vz - cxz * cxz AS det, (vz * cxd - cxz * czd) / (vx * vz - cxz * cxz) AS g, (vx * czd - cxz * cxd) / (vx * vz - cxz * cxz) AS h FROM v),
adf AS (SELECT m, g / sqrt(m * (vd - g * cxd - h * czd) / (m - 3) * vz / (m * det)) AS stat FROM b),
k AS (SELECT count(*) AS n, avg(n) AS mean, var_pop(n) AS var, ceil(12 * (count(*) / 100) ** 0.25)::BIGINT AS l FROM s), e AS (SELECT i, s.n - mean AS e, sum(s.n - mean) OVER (ORDER BY i) AS cum FROM s, k),
lr AS (SELECT any_value(var) + 2 * sum((1 - lag / (l + 1)) * gamma) AS lr FROM (SELECT lag, sum(p.e * q.e) / any_value(k.n) AS gamma FROM k, range(1, 200) r(lag) JOIN e p ON true JOIN e q ON q.i = p.i + lag WHERE lag <= k.l GROUP BY lag) x, k),
kp AS (SELECT sum(cum * cum) / any_value(k.n) ** 2 / any_value(lr) AS stat FROM e, k, lr)
SELECT 'adf' AS test, round(stat, 6) AS statistic, 1::BIGINT AS lags, m AS n, stat < -2.86154 - 2.8903 / m - 4.234 / m ** 2 - 40.04 / m ** 3 AS rejects FROM adf UNION ALL SELECT 'kpss', round(stat, 6), l, k.n, stat > 0.463 FROM kp, k""")
def _(t):
    return T.stationarity(series(t), "i", "n", adf_lags=1).select("test", F.round("statistic", 6).alias("statistic"), "lags", "n", "rejects")


@query("fc4_baselines", "FC-4", f"""WITH {_SERIES}, x AS (SELECT s.i, s.n, a.n AS l1, b.n AS l24, c.n AS l168, s.i % 24 AS h FROM s LEFT JOIN s a ON a.i = s.i - 1 LEFT JOIN s b ON b.i = s.i - 24 LEFT JOIN s c ON c.i = s.i - 168),
p AS (SELECT * FROM x, cut WHERE i <= cut), m AS (SELECT avg(n) AS mean, avg(abs(n - l24)) AS scale FROM p), hr AS (SELECT h, avg(n) AS by_hour FROM p GROUP BY 1),
f AS (SELECT x.n, mean, coalesce(by_hour, mean) AS hour, l1::DOUBLE AS last, l24::DOUBLE AS day, l168::DOUBLE AS week FROM x JOIN cut ON i > cut LEFT JOIN hr USING (h), m), u AS (UNPIVOT f ON mean, hour, last, day, week INTO NAME model VALUE p)
SELECT model, count(*) AS n, round(avg(abs(n - p)), 6) AS mae, round(sqrt(avg((n - p) ** 2)), 6) AS rmse, round(avg(abs(n - p)) / any_value(scale), 6) AS mase, round(1 - avg((n - p) ** 2) / var_pop(n), 6) AS r2 FROM u, m GROUP BY 1""")
def _(t):
    s = series(t)
    cut = _cut(s)
    return _round(H.errors(H.naive_forecasts(s, "i", "n", cut), ["model"], "y", "p", H.seasonal_scale(s, "i", "n", cut, 24)), 6)


@query("fc5_fold_table", "FC-5", f"""WITH {_SERIES}, x AS (SELECT s.i, s.n, a.n AS last, b.n AS day, least(floor((s.i - (SELECT min(i) FROM s)) * 6.0::DOUBLE / ((SELECT max(i) FROM s) - (SELECT min(i) FROM s) + 1)), 5)::BIGINT AS fold FROM s LEFT JOIN s a ON a.i = s.i - 1 LEFT JOIN s b ON b.i = s.i - 24),
sc AS (SELECT avg(abs(n - day)) AS scale FROM x, cut WHERE i <= cut), u AS (UNPIVOT (SELECT fold, n, last::DOUBLE AS last, day::DOUBLE AS day FROM x WHERE fold > 0) ON last, day INTO NAME model VALUE p),
f AS (SELECT fold, model, avg(abs(n - p)) AS mae, sqrt(avg((n - p) ** 2)) AS rmse, avg(abs(n - p)) / any_value(scale) AS mase, 1 - avg((n - p) ** 2) / var_pop(n) AS r2 FROM u, sc GROUP BY 1, 2)
SELECT model, count(*) AS folds, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std, round(avg(mase), 6) AS mase_mean, round(stddev_pop(mase), 6) AS mase_std, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std FROM f GROUP BY 1""")
def _(t):
    s = series(t)
    lo, hi = s.agg(F.min("i"), F.max("i")).first()
    wide = H.back(s, "i", "n", [1, 24]).withColumn("fold", F.least(F.floor((F.col("i") - lo) * 6.0 / (hi - lo + 1)), F.lit(5)).cast("bigint")).where("fold > 0")
    rows = wide.select("fold", F.col("n").cast("double").alias("y"), F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"lag_{k}").cast("double").alias("p")) for m, k in (("last", 1), ("day", 24))]))).where("p IS NOT NULL")
    folds = H.errors(rows, ["fold", "model"], "y", "p", H.seasonal_scale(s, "i", "n", _cut(s), 24))
    return folds.groupBy("model").agg(F.count(F.lit(1)).alias("folds"), *[F.round(f(m), 6).alias(f"{m}_{n}") for m in ("mae", "rmse", "mase", "r2") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


_HORIZONS = [1, 6, 24, 168]


@query("fc6_horizon_naive", "FC-6", f"""WITH {_SERIES}, h AS (SELECT unnest([1, 6, 24, 168]) AS h), k AS (SELECT h, 'last' AS model, h AS k FROM h UNION ALL SELECT h, 'season', ((h + 23) // 24) * 24 FROM h)
SELECT h::BIGINT AS horizon, model, count(*) AS n, round(avg(abs(s.n - b.n)), 6) AS mae FROM k, cut, s JOIN s b ON b.i = s.i - k.k WHERE s.i > cut GROUP BY 1, 2""")
def _(t):
    s = series(t)
    return _round(H.horizon_naive(s, "i", "n", _HORIZONS, _cut(s)), 6)


@query("fc6_horizon_study", "FC-6")
def _(t):
    s = series(t)
    table = durable_features(s)
    cut = _cut(s)
    return H.horizon_study(table, "i", [c for c in table.columns if c not in ("i", "y")], _HORIZONS, cut, H.seasonal_scale(s, "i", "n", cut, 24))


def durable_features(s):
    """The features written once; the columns' ages are part of the schema and so are kept."""
    return durable(H.feature_table(s, "i", "n"))


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "fare"]


def _banded(t):
    rows = durable(kept(t).select(*_KEYS, "distance", "duration", "discount", "pickup"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    forest = Q.fit(rows.where(F.col("pickup") < cut), ["distance", "duration", "discount"], "fare")
    return forest.predict(rows.where(F.col("pickup") >= cut), _KEYS)


@query("int5_quantile_forest", "INT-5")
def _(t):
    return _banded(t)


@query("int5_band_report", "INT-5 INT-1 INT-2")
def _(t):
    return E.intervals(_banded(t), 0.2, "fare", "q10", "q90")
