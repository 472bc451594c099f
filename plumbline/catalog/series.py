"""Hourly series of the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.catalog.evaluation import _round
from plumbline.catalog.registry import query
from plumbline.operators import series as S
from plumbline.plans import ordering

_GRID = """g AS (
  SELECT event_type, unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS hour FROM events GROUP BY 1),
c AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2),
h AS (SELECT g.event_type, g.hour, n, v FROM g LEFT JOIN c ON g.event_type = c.event_type AND g.hour = c.hour)"""
_KEY = "event_type, strftime(hour, '%Y-%m-%d %H') AS at"


def grid(t):
    return S.hourly(t.events, "ts", {"n": F.count(F.lit(1)), "v": F.sum("value")}, ["event_type"])


def _at():
    return F.date_format("hour", "yyyy-MM-dd HH").alias("at")


@query("ts1_grid", "TS-1 STR-2", f"WITH {_GRID} SELECT {_KEY}, n, round(v, 4) AS v FROM h")
def _(t):
    return grid(t).select("event_type", _at(), "n", F.round("v", 4).alias("v"))


@query("ts1_gaps", "TS-1", f"WITH {_GRID} SELECT event_type, count(*) AS n_hours, count_if(n IS NULL) AS n_missing FROM h GROUP BY 1")
def _(t):
    return grid(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_hours"), F.count_if(F.col("n").isNull()).alias("n_missing"))


_W = "OVER (PARTITION BY event_type ORDER BY hour)"


@query("win1_lags", "WIN-1 WIN-3 TS-2", f"WITH {_GRID} SELECT {_KEY}, lag(n, 1) {_W} AS lag_1, lag(n, 24) {_W} AS lag_24, lag(n, 168) {_W} AS lag_168, lag(n, 1) {_W} - lag(n, 25) {_W} AS delta_24 FROM h")
def _(t):
    g = S.lags(grid(t), "n", [1, 24, 25, 168], ["event_type"])
    return g.select("event_type", _at(), "lag_1", "lag_24", "lag_168", (F.col("lag_1") - F.col("lag_25")).alias("delta_24"))


def _roll(w: int) -> str:
    over = f"OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return ", ".join(f"CASE WHEN count(n) {over} >= {max(2, w // 4)} THEN round({f}(n) {over}, 6)::DOUBLE END AS {name}_{w}" for name, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max")))


@query("win2_trailing", "WIN-2 TS-2", f"WITH {_GRID} SELECT {_KEY}, {_roll(24)}, {_roll(168)} FROM h")
def _(t):
    g = S.trailing(grid(t), "n", [24, 168], ["event_type"])
    return g.select("event_type", _at(), *[F.round(F.col(f"roll_{m}_{w}").cast("double"), 6).alias(f"{m}_{w}") for w in (24, 168) for m in ("mean", "std", "max")])


@query("ts3_warm_up", "TS-3", f"WITH {_GRID}, x AS (SELECT n, lag(n, 168) {_W} AS w FROM h) SELECT count(*) AS n_raw, count_if(n IS NULL) AS n_missing_target, count_if(n IS NOT NULL AND w IS NULL) AS n_warm_up, count_if(n IS NOT NULL AND w IS NOT NULL) AS n_kept FROM x")
def _(t):
    g = S.lags(grid(t), "n", [168], ["event_type"])
    n, w = F.col("n"), F.col("lag_168")
    return g.agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(n.isNull()).alias("n_missing_target"), F.count_if(n.isNotNull() & w.isNull()).alias("n_warm_up"), F.count_if(n.isNotNull() & w.isNotNull()).alias("n_kept"))


_ALL = "a AS (SELECT epoch(date_trunc('hour', ts))::BIGINT // 3600 AS i, count(*) AS n FROM events GROUP BY 1)"


def _counts(t):
    """(i, n): events per hour, hours numbered."""
    return t.events.groupBy((F.unix_timestamp(F.date_trunc("hour", "ts").cast("timestamp")) / 3600).cast("bigint").alias("i")).agg(F.count(F.lit(1)).alias("n"))


@query("ts4_autocorrelation", "TS-4", f"""WITH {_ALL}, m AS (SELECT avg(n) AS mean, count(*) AS k FROM a), x AS (SELECT i, n - mean AS x FROM a, m), b AS (SELECT sum(x * x) AS b FROM x)
SELECT lag, round(sum(p.x * q.x) / any_value(b), 6) AS acf, round(1.96 / sqrt(any_value(k)), 6) AS band FROM range(73) l(lag), x p, x q, b, m WHERE q.i = p.i + lag GROUP BY 1""")
def _(t):
    return _round(S.autocorrelation(_counts(t), "i", "n", 72), 6)


@query("ts6_profile", "TS-6", "WITH c AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1) SELECT hour(h) AS hour, isodow(h) < 6 AS working, count(*) AS hours, round(avg(n), 6) AS mean FROM c GROUP BY 1, 2")
def _(t):
    c = t.events.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(F.hour("h").cast("bigint").alias("hour"), (F.weekday("h") < 5).alias("working")).agg(F.count(F.lit(1)).alias("hours"), F.round(F.avg("n"), 6).alias("mean"))


@query("ts7_code_effect", "TS-7", "WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS mean, median(value) AS median FROM events GROUP BY 1), f AS (SELECT mean AS m FROM s ORDER BY event_type LIMIT 1) SELECT event_type, n, round(mean, 4) AS mean, round(median, 4) AS median, round(mean / m, 6) AS ratio FROM s, f")
def _(t):
    means = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    both = means.join(ordering.quantile_columns(t.events, "value", {"median": 0.5}, ["event_type"]), "event_type")
    first = means.agg(F.min_by("mean", "event_type")).first()[0]
    return both.select("event_type", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round(F.col("mean") / F.lit(first), 6).alias("ratio"))


@query("ts8_interpolated", "TS-8", f"""WITH {_GRID}, x AS (SELECT *, epoch(hour)::DOUBLE AS e, CASE WHEN v IS NOT NULL THEN epoch(hour)::DOUBLE END AS ev FROM h),
y AS (SELECT *, last_value(ev IGNORE NULLS) OVER a AS x0, last_value(v IGNORE NULLS) OVER a AS y0, first_value(ev IGNORE NULLS) OVER b AS x1, first_value(v IGNORE NULLS) OVER b AS y1 FROM x
  WINDOW a AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {_KEY}, round(coalesce(v, CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (e - x0) / (x1 - x0) ELSE y0 END, y0, y1), 6) AS v FROM y""")
def _(t):
    return S.interpolated(grid(t), "v", ["event_type"], "filled").select("event_type", _at(), F.round("filled", 6).alias("v"))


@query("ts12_recent", "TS-12", "WITH c AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1) SELECT strftime(h, '%Y-%m-%d %H') AS at, n FROM c WHERE h > (SELECT max(h) FROM c) - INTERVAL 336 HOUR")
def _(t):
    c = t.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    last = c.agg(F.max("hour")).first()[0]
    return c.where(F.col("hour") > F.lit(last) - F.expr("interval 336 hours")).select(_at(), "n")


_SEASON = f"{_ALL}, s AS (SELECT a.i, a.n, b.n AS y1, c.n AS y24 FROM a LEFT JOIN a b ON b.i = a.i - 1 LEFT JOIN a c ON c.i = a.i - 24), cut AS (SELECT min(i) + (max(i) - min(i)) * 4 // 5 AS cut FROM a), sc AS (SELECT avg(abs(n - y24)) AS scale FROM s, cut WHERE i <= cut)"


def _season(t):
    a = _counts(t)
    back = lambda k, name: a.select((F.col("i") + k).alias("i"), F.col("n").alias(name))
    s = a.join(back(1, "y1"), "i", "left").join(back(24, "y24"), "i", "left")
    lo, hi = a.agg(F.min("i"), F.max("i")).first()
    return s, lo + (hi - lo) * 4 // 5


@query("fc1_mase", "FC-1 FC-2 FC-3 FC-4", f"""WITH {_SEASON}, e AS (SELECT n, y1 AS p, y24 AS q FROM s, cut WHERE i > cut AND y1 IS NOT NULL AND y24 IS NOT NULL)
SELECT count(*) AS n, round(avg(abs(n - p)) / any_value(scale), 6) AS mase_last, round(avg(abs(n - q)) / any_value(scale), 6) AS mase_day, round(avg(CASE WHEN n + p = 0 THEN 0 ELSE 2.0::DOUBLE * abs(n - p) / (abs(n) + abs(p)) END), 6) AS smape_last, round(1 - avg(abs(n - p)) / avg(abs(n - q)), 6) AS skill FROM e, sc""")
def _(t):
    s, cut = _season(t)
    scale = s.where(F.col("i") <= cut).agg(F.avg(F.abs(F.col("n") - F.col("y24")))).first()[0]
    e = s.where((F.col("i") > cut) & F.col("y1").isNotNull() & F.col("y24").isNotNull())
    n, p, q = F.col("n"), F.col("y1"), F.col("y24")
    m1, m24 = F.avg(F.abs(n - p)), F.avg(F.abs(n - q))
    smape = F.avg(F.when(n + p == 0, 0.0).otherwise(2.0 * F.abs(n - p) / F.greatest(F.abs(n) + F.abs(p), F.lit(1))))
    return _round(e.agg(F.count(F.lit(1)).alias("n"), (m1 / F.lit(scale)).alias("mase_last"), (m24 / F.lit(scale)).alias("mase_day"), smape.alias("smape_last"), (1 - m1 / m24).alias("skill")), 6)


@query("fc5_backtest", "FC-5", f"""WITH {_SEASON}, f AS (SELECT *, ntile AS fold FROM (SELECT s.*, least(floor((i - (SELECT min(i) FROM a)) * 6.0::DOUBLE / ((SELECT max(i) FROM a) - (SELECT min(i) FROM a) + 1)), 5)::BIGINT AS ntile FROM s))
SELECT fold, model, count(*) AS n, round(avg(abs(n - p)), 6) AS mae, round(sqrt(avg((n - p) * (n - p))), 6) AS rmse FROM (SELECT fold, 'last' AS model, n, y1 AS p FROM f UNION ALL SELECT fold, 'day', n, y24 FROM f) WHERE fold > 0 AND p IS NOT NULL GROUP BY 1, 2""")
def _(t):
    s, _ = _season(t)
    lo, hi = s.agg(F.min("i"), F.max("i")).first()
    fold = F.least(F.floor((F.col("i") - lo) * 6.0 / (hi - lo + 1)), F.lit(5)).cast("bigint")
    models = F.array(F.struct(F.lit("last").alias("model"), F.col("y1").alias("p")), F.struct(F.lit("day").alias("model"), F.col("y24").alias("p")))
    rows = s.select(fold.alias("fold"), "n", F.inline(models)).where("fold > 0 and p is not null")
    e = F.col("n") - F.col("p")
    return rows.groupBy("fold", "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


@query("ts5_partial_autocorrelation", "TS-5")
def _(t):
    acf = [r["acf"] for r in S.autocorrelation(_counts(t), "i", "n", 24).orderBy("lag").collect()]  # 25 numbers
    return t.spark.range(1).select(F.posexplode(F.array(*[F.lit(float(v)) for v in S.partial_autocorrelation(acf)])).alias("lag", "pacf"))


_TREND = f"""WITH {_ALL}, w AS (SELECT i, n, CASE WHEN count(*) OVER x = 25 THEN (sum(n) OVER x - 0.5 * (first_value(n) OVER x + last_value(n) OVER x)) / 24 END AS trend FROM a WINDOW x AS (ORDER BY i RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
p AS (SELECT i % 24 AS phase, avg(n - trend) AS s FROM w GROUP BY 1), m AS (SELECT avg(s) AS m FROM p), d AS (SELECT i, n, trend, s - m AS seasonal, n - trend - (s - m) AS residual FROM w JOIN p ON i % 24 = phase, m)"""


@query("ts9_decomposition", "TS-9", f"{_TREND} SELECT i, n, round(trend, 6)::DOUBLE AS trend, round(seasonal, 6)::DOUBLE + 0.0 AS seasonal, round(residual, 6)::DOUBLE + 0.0 AS residual FROM d")
def _(t):
    out = S.decomposed(_counts(t), "i", "n", 24)
    return out.select("i", "n", F.round("trend", 6).alias("trend"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("seasonal", "residual")])


@query("ts11_band", "TS-11", f"{_TREND} SELECT i, n, n BETWEEN trend + seasonal - 5 AND trend + seasonal + 5 AS inside FROM d WHERE trend IS NOT NULL AND abs(abs(residual) - 5) > 1e-9")
def _(t):
    out = S.decomposed(_counts(t), "i", "n", 24).where(F.col("trend").isNotNull() & (F.abs(F.abs("residual") - 5) > 1e-9))
    centre = F.col("trend") + F.col("seasonal")
    return out.select("i", "n", F.col("n").between(centre - 5, centre + 5).alias("inside"))


@query("win9_first_difference", "WIN-9", "WITH c AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, strftime(h, '%Y-%m-%d %H') AS at, n - lag(n) OVER (PARTITION BY event_type ORDER BY h) AS d FROM c")
def _(t):
    c = t.events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy("hour")
    return c.select("event_type", _at(), (F.col("n") - F.lag("n").over(w)).alias("d"))


@query("scr7_forecast_rows", "SCR-7", f"WITH {_SEASON}, md AS (SELECT median(n) AS m FROM a) SELECT i, round(0.5 * coalesce(y1, m) + 0.5 * coalesce(y24, m), 4)::DOUBLE AS forecast, round(0.5 * coalesce(y1, m) + 0.5 * coalesce(y24, m) - 6, 4)::DOUBLE AS low, round(0.5 * coalesce(y1, m) + 0.5 * coalesce(y24, m) + 6, 4)::DOUBLE AS high FROM s, md")
def _(t):
    s, _ = _season(t)
    m = ordering.quantile_list(_counts(t), "n", [0.5])[0]
    f = 0.5 * F.coalesce(F.col("y1").cast("double"), F.lit(m)) + 0.5 * F.coalesce(F.col("y24").cast("double"), F.lit(m))
    return s.select("i", F.round(f, 4).alias("forecast"), F.round(f - 6, 4).alias("low"), F.round(f + 6, 4).alias("high"))


@query("scr8_scenario_day", "SCR-8", "WITH c AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1), p AS (SELECT hour(h) AS hour, avg(n) AS m FROM c GROUP BY 1), f AS (SELECT * FROM (VALUES ('clear', 1.0::DOUBLE), ('rain', 0.8::DOUBLE), ('storm', 0.5::DOUBLE)) v(scenario, factor)) SELECT scenario, round(sum(m * factor), 4) AS total, round(sum(m) - sum(m * factor), 4) AS loss FROM p, f GROUP BY 1")
def _(t):
    c = t.events.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    p = c.groupBy(F.hour("h").alias("hour")).agg(F.avg("n").alias("m"))
    cases = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("factor")) for k, v in (("clear", 1.0), ("rain", 0.8), ("storm", 0.5))])
    rows = p.select("m", F.inline(cases))
    return rows.groupBy("scenario").agg(F.round(F.sum(F.col("m") * F.col("factor")), 4).alias("total"), F.round(F.sum("m") - F.sum(F.col("m") * F.col("factor")), 4).alias("loss"))
