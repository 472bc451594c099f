"""Outliers among the customers and the events, and density clusters of the customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.evaluation import _round
from plumbline.catalog.registry import query
from plumbline.catalog.segmentation import _RFM, rfm
from plumbline.operators import neighbours as N
from plumbline.operators import outliers as O
from plumbline.plans import ordering
from plumbline.session import durable, shared_folder

#: Customers as points: the logarithms of recency, frequency and spend.
_POINTS = f"{_RFM}, x AS (SELECT customer, ln(1 + recency) AS a, ln(1 + frequency) AS b, ln(1 + monetary) AS c FROM rfm)"
_PAIRS = """d AS (SELECT p.customer AS p, q.customer AS q, sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2 + (p.c - q.c) ** 2) AS d FROM x p JOIN x q ON p.customer <> q.customer)"""


def _near(k: int) -> str:
    return f"{_PAIRS}, r AS (SELECT *, rank() OVER (PARTITION BY p ORDER BY d) AS r FROM d), near AS (SELECT p, q, d, max(d) OVER (PARTITION BY p) AS kdist FROM r WHERE r <= {k})"


def points(t):
    return rfm(t).select("customer", F.array(*[F.log1p(F.col(c).cast("double")) for c in ("recency", "frequency", "monetary")]).alias("x"))


@query("knn_table", "JOIN-11 SEG-8", f"WITH {_POINTS}, {_near(8)} SELECT p AS customer, count(*) AS n, round(max(kdist), 6) AS kdist, round(sum(d), 6) AS total FROM near GROUP BY 1")
def _(t):
    near = N.neighbour_table(points(t), "customer", "x", 8)
    return near.groupBy(F.col("id").alias("customer")).agg(
        F.sum("w").cast("bigint").alias("n"), F.round(F.max("kdist"), 6).alias("kdist"), F.round(F.sum(F.col("d") * F.col("w")), 6).alias("total"))


@query("ano2_local_outlier_factor", "ANO-2", f"""WITH {_POINTS}, {_near(20)}, far AS (SELECT p, max(kdist) AS kdist FROM near GROUP BY 1),
lrd AS (SELECT near.p, 1 / (avg(greatest(d, far.kdist)) + 1e-10) AS lrd FROM near JOIN far ON far.p = near.q GROUP BY 1)
SELECT near.p AS customer, round(avg(o.lrd) / any_value(s.lrd), 6) AS lof FROM near JOIN lrd o ON o.p = near.q JOIN lrd s ON s.p = near.p GROUP BY 1""")
def _(t):
    return N.outlier_factor(points(t), "customer", "x", 20).select(F.col("id").alias("customer"), F.round("lof", 6).alias("lof"))


@query("seg7_density_clusters", "SEG-7", f"""WITH RECURSIVE {_POINTS}, {_PAIRS},
e AS (SELECT * FROM d WHERE d <= 0.6), core AS (SELECT p FROM (SELECT customer AS p FROM x UNION ALL SELECT p FROM e) GROUP BY 1 HAVING count(*) >= 8),
l AS (SELECT e.p, e.q FROM e JOIN core a ON e.p = a.p JOIN core b ON e.q = b.p),
w AS (SELECT p, p AS low FROM core UNION SELECT l.q, w.low FROM w JOIN l ON l.p = w.p WHERE w.low < l.q),
low AS (SELECT p, min(low) AS low FROM w GROUP BY 1), c AS (SELECT p, dense_rank() OVER (ORDER BY low) - 1 AS cluster FROM low),
edge AS (SELECT e.p, arg_min(c.cluster, (e.d, e.q)) AS cluster FROM e JOIN c ON c.p = e.q GROUP BY 1)
SELECT customer, coalesce(c.cluster, edge.cluster, -1)::BIGINT AS cluster, c.p IS NOT NULL AS core FROM x LEFT JOIN c ON c.p = customer LEFT JOIN edge ON edge.p = customer""")
def _(t):
    return N.density_clusters(points(t), "customer", "x", 0.6, 8).withColumnRenamed("id", "customer")


@query("seg8_eps_sweep", "SEG-8")
def _(t):
    p = durable(points(t))
    return N.eps_sweep(p, "customer", "x", max(5, p.count() // 400), shares=(0.7, 0.85, 0.95, 0.99))


FEATURES = ["value", "hour", "day", "size"]


def _events(t):
    return t.events.select("event_id", F.col("value").cast("double").alias("value"), F.hour("ts").cast("double").alias("hour"), F.dayofmonth("ts").cast("double").alias("day"), F.length("props").cast("double").alias("size"))


@query("ano1_isolation_forest", "ANO-1")
def _(t):
    e = _events(t)
    return O.IsolationForest.fit(e, "event_id", FEATURES, trees=100, sample=1024).scored(e, "event_id")


@query("ano3_one_class", "ANO-3")
def _(t):
    e = _scaled_events(t)
    model = O.one_class(e, ["a", "b", "c"], 0.03)
    return e.select("event_id", model.score().alias("score"), (model.score() > 0).alias("outside"))


def _scaled_events(t):
    """Features from 0 to 2 about their mean, so that a plane can part them from the origin."""
    e = _events(t)
    m = e.agg(*[f(c).alias(f"{n}_{c}") for c in ("value", "hour", "day") for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return e.select("event_id", *[(1 + (F.col(c) - m[f"m_{c}"]) / (3 * (m[f"s_{c}"] or 1.0))).alias(a) for a, c in (("a", "value"), ("b", "hour"), ("c", "day"))])


_E4 = "e AS (SELECT event_id, value AS a, hour(ts)::DOUBLE AS b FROM events)"
_M = "avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c"
_D = "((a - ma) * (a - ma) * vb - 2 * (a - ma) * (b - mb) * c + (b - mb) * (b - mb) * va) / (va * vb - c * c)"


def _two(t):
    return t.events.select("event_id", F.col("value").cast("double").alias("a"), F.hour("ts").cast("double").alias("b"))


@query("ano4_first_step", "ANO-4", f"WITH {_E4}, m AS (SELECT {_M} FROM e), d AS (SELECT event_id, a, b, {_D} AS d FROM e, m), k AS (SELECT * FROM d WHERE d <= (SELECT quantile_cont(d, 0.9) FROM d)), m2 AS (SELECT {_M} FROM k) SELECT event_id, round({_D}, 6) AS distance FROM e, m2")
def _(t):
    found = O.envelope(_two(t), ["a", "b"], steps=1)
    return _two(t).select("event_id", F.round(found.distance(), 6).alias("distance"))


@query("ano4_robust_envelope", "ANO-4")
def _(t):
    e = _scaled_events(t)
    found = O.envelope(e, ["a", "b", "c"])
    return e.select("event_id", found.distance().alias("distance"))


@query("ano7_flagged_deviation", "ANO-7", """WITH e AS (SELECT value, hour(ts)::DOUBLE AS hour, day(ts)::DOUBLE AS day, length(props)::DOUBLE AS size, event_type = 'error' AS f FROM events),
m AS (UNPIVOT (SELECT f, value, hour, day, size FROM e) ON value, hour, day, size INTO NAME feature VALUE v),
a AS (SELECT feature, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, quantile_cont(v, 0.5) FILTER (WHERE f) AS flagged_median FROM m GROUP BY 1)
SELECT feature, round(median, 6) AS median, round(flagged_median, 6) AS flagged_median, round(iqr, 6) AS iqr, round((flagged_median - median) / CASE WHEN iqr > 0 THEN iqr ELSE 1 END, 6) + 0.0 AS deviation FROM a""")
def _(t):
    out = O.flagged_deviation(_events(t).join(t.events.select("event_id", "event_type"), "event_id"), FEATURES, F.col("event_type") == "error")
    return out.select("feature", *[(F.round(c, 6) + 0.0).alias(c) for c in ("median", "flagged_median", "iqr", "deviation")])


@query("scr9_scored_events", "SCR-9 MDL-17")
def _(t):
    """Scores by a forest that was saved and read again, with the features that deviate most, for the strangest 2 %."""
    import uuid

    e = _events(t)
    path = f"{shared_folder(t.spark)}/forest-{uuid.uuid4().hex}"
    O.IsolationForest.fit(e, "event_id", FEATURES, trees=60, sample=512).save(path)
    scores = O.IsolationForest.load(t.spark, path, FEATURES).scored(e, "event_id")
    cut = ordering.quantile_list(scores, "score", [0.98])[0]
    strange = scores.where(F.col("score") >= F.lit(cut)).select("event_id", "score")
    return O.deviating(e, "event_id", FEATURES, 3).join(strange, "event_id").select("event_id", "score", "place", "feature", "value", "deviation")
