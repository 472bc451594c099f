"""Segments of the customers, and clusters of the embeddings."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.catalog.evaluation import _round
from plumbline.catalog.registry import query
from plumbline.catalog.trips import zones
from plumbline.operators import segments as S
from plumbline.plans import ordering

_LINES = "ln AS (SELECT o_custkey AS customer, o_orderkey AS \"order\", l_partkey AS item, o_orderdate AS day, l_extendedprice * (1 - l_discount) AS amount, l_quantity AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
_RFM = f"""{_LINES}, rfm AS (SELECT customer, date_diff('day', max(day), (SELECT max(day) FROM ln)) + 1 AS recency, count(DISTINCT "order") AS frequency, sum(amount) AS monetary, count(DISTINCT item) AS n_items, sum(quantity) AS quantity,
  date_diff('day', min(day), max(day)) AS tenure, sum(amount) / count(DISTINCT "order") AS basket_value FROM ln GROUP BY 1)"""


def lines(t):
    j = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"), F.col("l_partkey").alias("item"), F.col("o_orderdate").alias("day"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"), F.col("l_quantity").alias("quantity"))


def rfm(t):
    return S.rfm(lines(t))


@query("seg1_rfm", "SEG-1 AGG-4 FE-15", f"WITH {_RFM} SELECT customer, recency, frequency, round(monetary, 2) AS monetary, n_items, quantity, tenure, round(basket_value, 4) AS basket_value FROM rfm")
def _(t):
    return rfm(t).select("customer", "recency", "frequency", F.round("monetary", 2).alias("monetary"), "n_items", "quantity", "tenure", F.round("basket_value", 4).alias("basket_value"))


def _q(rn: str) -> str:
    return f"CASE WHEN {rn} <= 1 + (n - 1) * 0.2 THEN 1 WHEN {rn} <= 1 + (n - 1) * 0.4 THEN 2 WHEN {rn} <= 1 + (n - 1) * 0.6 THEN 3 WHEN {rn} <= 1 + (n - 1) * 0.8 THEN 4 ELSE 5 END"


_SCORES = f"""{_RFM}, k AS (SELECT customer, monetary, count(*) OVER () AS n, row_number() OVER (ORDER BY -recency, customer) AS a, row_number() OVER (ORDER BY frequency, customer) AS b, row_number() OVER (ORDER BY monetary, customer) AS c FROM rfm),
sc AS (SELECT customer, monetary, {_q('a')} AS r, {_q('b')} AS f, {_q('c')} AS m FROM k)"""


@query("seg2_scores", "SEG-2 WIN-5", f"WITH {_SCORES} SELECT customer, r, f, m, r + f + m AS total, r::VARCHAR || f::VARCHAR || m::VARCHAR AS cell FROM sc")
def _(t):
    return S.rfm_scores(rfm(t)).select("customer", "r", "f", "m", "total", "cell")


@query("seg3_grid", "SEG-3", f"WITH {_SCORES} SELECT r.range AS r, f.range AS f, count(customer) AS n FROM range(1, 6) r CROSS JOIN range(1, 6) f LEFT JOIN sc ON sc.r = r.range AND sc.f = f.range GROUP BY 1, 2")
def _(t):
    from plumbline.operators.relational import completed

    counts = S.rfm_scores(rfm(t)).groupBy("r", "f").agg(F.count(F.lit(1)).alias("n"))
    return completed(counts, {"r": range(1, 6), "f": range(1, 6)}, {"n": 0})


@query("seg23_country_mix", "SEG-23", f"WITH {_RFM} SELECT n_name AS country, count(*) AS n, round(avg(monetary), 2) AS mean_spend FROM rfm JOIN customer ON customer = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    z = zones(t).select("n_nationkey", F.col("n_name").alias("country"))
    j = rfm(t).join(t.customer, F.col("customer") == F.col("c_custkey")).join(z, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("monetary"), 2).alias("mean_spend"))


@query("seg15_profiles", "SEG-15", f"WITH {_SCORES}, p AS (SELECT r AS segment, monetary FROM sc) SELECT segment, count(*) AS n, round(median(monetary), 2) AS median_spend, round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM p), 6) AS share, round(sum(monetary) / (SELECT sum(monetary) FROM p), 6) AS revenue_share FROM p GROUP BY 1")
def _(t):
    p = S.rfm_scores(rfm(t)).select(F.col("r").alias("segment"), "monetary")
    sums = p.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("monetary").alias("s"))
    n, s = sums.agg(F.sum("n"), F.sum("s")).first()
    both = sums.join(ordering.quantile_columns(p, "monetary", {"q": 0.5}, ["segment"]), "segment")
    return both.select("segment", "n", F.round("q", 2).alias("median_spend"), F.round(F.col("n") / F.lit(n), 6).alias("share"), F.round(F.col("s") / F.lit(s), 6).alias("revenue_share"))


@query("seg18_eta", "SEG-18", f"""WITH {_SCORES}, v AS (SELECT r, ln(1 + rfm.monetary) AS v FROM sc JOIN rfm USING (customer)), g AS (SELECT r, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM v GROUP BY 1), a AS (SELECT avg(v) AS mean FROM v)
SELECT 'monetary' AS col, round(sum(n * pow(m - mean, 2)) / (sum(n * pow(m - mean, 2)) + sum(n * s)), 6) AS eta2 FROM g, a""")
def _(t):
    return _round(S.eta_squared(S.rfm_scores(rfm(t)), ["monetary"], "r"), 6)


_EMB = "x AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def labelled(t):
    return t.embeddings.select("vec_id", F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("x"))


@query("seg9_silhouette", "SEG-9", f"""WITH {_EMB}, d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM x a, x b GROUP BY 1, 2, 3),
n AS (SELECT label, count(*) AS n FROM x GROUP BY 1), m AS (SELECT vec_id, own, min(CASE WHEN own <> other THEN d / n END) AS b, max(CASE WHEN own = other THEN d / greatest(1, n - 1) END) AS a, max(CASE WHEN own = other THEN n END) AS n FROM d JOIN n ON n.label = other GROUP BY 1, 2)
SELECT vec_id, round(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS silhouette FROM m""")
def _(t):
    return S.silhouettes(labelled(t)).select("vec_id", F.round("silhouette", 6).alias("silhouette"))


_SIL = f"""{_EMB}, d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM x a, x b GROUP BY 1, 2, 3),
n AS (SELECT label, count(*) AS n FROM x GROUP BY 1), m AS (SELECT vec_id, own, min(CASE WHEN own <> other THEN d / n END) AS b, max(CASE WHEN own = other THEN d / greatest(1, n - 1) END) AS a, max(CASE WHEN own = other THEN n END) AS n FROM d JOIN n ON n.label = other GROUP BY 1, 2)"""


@query("seg22_silhouette_histogram", "SEG-22", f"WITH {_SIL}, s AS (SELECT own AS cluster, CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM m) SELECT cluster, least(floor((s + 0.4::DOUBLE) / 0.0875::DOUBLE), 15)::BIGINT AS bin, count(*) AS n FROM s WHERE s BETWEEN -0.4 AND 1 GROUP BY 1, 2")
def _(t):
    from plumbline.operators.evaluation import histogram

    return histogram(S.silhouettes(labelled(t)), "silhouette", -0.4, 1.0, 16, ["cluster"])


@query("seg10_separation", "SEG-10", f"""WITH {_EMB}, v AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(x) AS v FROM x), c AS (SELECT label, i, avg(v) AS c FROM v GROUP BY 1, 2), g AS (SELECT i, avg(v) AS g FROM v GROUP BY 1),
r AS (SELECT vec_id, v.label, sum((v - c) ** 2) AS d2 FROM v JOIN c ON v.label = c.label AND v.i = c.i GROUP BY 1, 2), s AS (SELECT label, avg(sqrt(d2)) AS s, sum(d2) AS w, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) ** 2)) AS gap FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2), w AS (SELECT a, max((x.s + y.s) / gap) AS worst FROM p JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY 1),
bt AS (SELECT sum(n * e) AS between FROM (SELECT c.label, sum((c - g) ** 2) AS e FROM c JOIN g ON c.i = g.i GROUP BY 1) e JOIN s ON s.label = e.label)
SELECT sum(n)::BIGINT AS n, round((SELECT avg(worst) FROM w), 6) AS davies_bouldin, round((SELECT between FROM bt) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))), 6) AS calinski_harabasz FROM s""")
def _(t):
    x = labelled(t)
    found = S.separation(x)
    return x.agg(F.count(F.lit(1)).alias("n")).select("n", *[F.round(F.lit(v), 6).alias(k) for k, v in found.items()])


@query("seg13_adjusted_rand", "SEG-13", "WITH e AS (SELECT label AS a, vec_id % 7 AS b FROM embeddings), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM e GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT sum(n) AS n FROM c GROUP BY a)), j AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT sum(n) AS n FROM c GROUP BY b)), s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t FROM c) SELECT round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) AS ari FROM i, j, s")
def _(t):
    e = t.embeddings.select(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b"))
    return S.adjusted_rand(e, "a", "b").select(F.round("ari", 6).alias("ari"))


def _scaled(t):
    return S.vectors(rfm(t).withColumns({c: F.log1p(F.col(c).cast("double")) for c in ("recency", "frequency", "monetary")}), ["recency", "frequency", "monetary"])


@query("seg4_k_means", "SEG-4 SEG-20 JOIN-10")
def _(t):
    df = _scaled(t)
    model = KMeans(k=4, seed=42, featuresCol="features", predictionCol="cluster").fit(df)
    out = S.as_array(model.transform(df))
    d = [F.sqrt(F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)) for c in model.clusterCenters()]
    near = F.array_sort(F.array(*d))
    ratio = F.element_at(near, 1) / F.element_at(near, 2)
    return out.select("customer", "cluster", ratio.alias("distance_ratio"), F.when(ratio < 0.6, "sure").when(ratio < 0.85, "likely").otherwise("unsure").alias("confidence"))


@query("seg5_gaussian_mixture", "SEG-5")
def _(t):
    df = _scaled(t)
    return GaussianMixture(k=3, seed=42, featuresCol="features", predictionCol="cluster").fit(df).transform(df).select("customer", "cluster")


@query("seg6_hierarchical", "SEG-6")
def _(t):
    df = _scaled(t)
    return BisectingKMeans(k=4, seed=42, featuresCol="features", predictionCol="cluster").fit(df).transform(df).select("customer", "cluster")


@query("seg19_pca", "SEG-19 ANO-5")
def _(t):
    """Projection to two components, and the squared error of putting it back."""
    df = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="z").fit(df)
    out = S.as_array(S.as_array(model.transform(df)), "z", "p")
    xx, pp = (F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v) for c in ("x", "p"))
    return out.select("vec_id", F.col("p")[0].alias("pc1"), F.col("p")[1].alias("pc2"), (xx - pp).alias("error"))


_E = "e AS (SELECT event_id, event_type, value AS s, hour(ts) AS h FROM events)"


@query("ano6_rank_fusion", "ANO-6 WIN-7", f"WITH {_E}, r AS (SELECT event_id, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER () - 1) AS a, (rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER () - 1) AS b FROM e) SELECT event_id, round((a + b) / 2, 6) AS fused FROM r")
def _(t):
    e = t.events.select("event_id", F.col("value").alias("s"), F.hour("ts").alias("h"))
    n = e.count()
    norm = lambda c: ordering.average_ranks(e, c, out=f"r_{c}").select(c, ((F.col(f"r_{c}") - 1) / (n - 1)).alias(f"n_{c}"))
    both = e.join(norm("s"), "s").join(norm("h"), "h")
    return both.select("event_id", F.round((F.col("n_s") + F.col("n_h")) / 2, 6).alias("fused"))


@query("ano8_deviation", "ANO-7 ANO-8", f"WITH {_E}, m AS (SELECT median(s) AS med, max(s) - min(s) AS range FROM e) SELECT event_id, round((s - med) / range, 6) + 0.0 AS deviation FROM e, m")
def _(t):
    med = ordering.quantile_list(t.events, "value", [0.5])[0]
    lo, hi = t.events.agg(F.min("value"), F.max("value")).first()
    return t.events.select("event_id", (F.round((F.col("value") - med) / (hi - lo), 6) + 0.0).alias("deviation"))


@query("ano9_families", "ANO-9", "SELECT event_type, count(*) AS n, round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM events WHERE event_type <> 'view'), 6) AS share FROM events WHERE event_type <> 'view' GROUP BY 1")
def _(t):
    counts = t.events.where("event_type <> 'view'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return counts.select("event_type", "n", F.round(F.col("n") / F.lit(total), 6).alias("share"))


@query("ano10_contamination_cut", "ANO-10", "WITH c AS (SELECT quantile_cont(value, 0.97) AS cut FROM events) SELECT event_id, value >= cut AS flagged FROM events, c")
def _(t):
    cut = ordering.quantile_list(t.events, "value", [0.97])[0]
    return t.events.select("event_id", (F.col("value") >= cut).alias("flagged"))


@query("ano11_examples", "ANO-11", "WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS rn, count(*) OVER () AS n FROM events) SELECT event_id, CASE WHEN rn <= 5 THEN 'top' ELSE 'median' END AS kind FROM r WHERE rn <= 5 OR (rn > n // 2 AND rn <= n // 2 + 5)")
def _(t):
    r = ordering.with_group_size(ordering.row_numbers(t.events.select("event_id", "value"), [-F.col("value"), F.col("event_id")]), [])
    half = F.floor(F.col("n") / 2)
    return r.where((F.col("rn") <= 5) | ((F.col("rn") > half) & (F.col("rn") <= half + 5))).select("event_id", F.when(F.col("rn") <= 5, "top").otherwise("median").alias("kind"))


@query("ano4_mahalanobis", "ANO-4", """WITH e AS (SELECT event_id, value AS a, hour(ts)::DOUBLE AS b FROM events), m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM e)
SELECT event_id, round(((a - ma) * (a - ma) * vb - 2 * (a - ma) * (b - mb) * c + (b - mb) * (b - mb) * va) / (va * vb - c * c), 6) AS distance FROM e, m""")
def _(t):
    """Squared Mahalanobis distance of (value, hour); a singular covariance is an error, not a score."""
    e = t.events.select("event_id", F.col("value").cast("double").alias("a"), F.hour("ts").cast("double").alias("b"))
    ma, mb, va, vb, c = e.agg(F.avg("a"), F.avg("b"), F.var_pop("a"), F.var_pop("b"), F.covar_pop("a", "b")).first()
    det = va * vb - c * c
    if det <= 1e-12 * va * vb:
        raise ValueError("the covariance is singular")
    x, y = F.col("a") - ma, F.col("b") - mb
    return e.select("event_id", F.round((x * x * vb - 2 * x * y * c + y * y * va) / det, 6).alias("distance"))


@query("seg16_personas", "SEG-16", f"WITH {_RFM}, m AS (SELECT median(frequency) AS f, median(monetary) AS v FROM rfm), x AS (SELECT customer, frequency / f AS a, monetary / v AS b FROM rfm, m) SELECT customer, CASE WHEN a >= 1.5 THEN 'devoted' WHEN a >= 1 THEN 'regular' WHEN a >= 0.5 THEN 'occasional' ELSE 'rare' END || ' / ' || CASE WHEN b >= 2 THEN 'top value' WHEN b >= 1 THEN 'good value' WHEN b >= 0.5 THEN 'fair value' ELSE 'small value' END AS persona FROM x")
def _(t):
    r = rfm(t)
    f, v = ordering.quantile_list(r, "frequency", [0.5])[0], ordering.quantile_list(r, "monetary", [0.5])[0]
    a, b = F.col("frequency") / f, F.col("monetary") / v
    engagement = F.when(a >= 1.5, "devoted").when(a >= 1, "regular").when(a >= 0.5, "occasional").otherwise("rare")
    value = F.when(b >= 2, "top value").when(b >= 1, "good value").when(b >= 0.5, "fair value").otherwise("small value")
    return r.select("customer", F.concat_ws(" / ", engagement, value).alias("persona"))
