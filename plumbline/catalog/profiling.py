"""Profiles of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.evaluation import _round
from plumbline.catalog.registry import query
from plumbline.catalog.trips import SCORED_SQL, scored
from plumbline.operators import profile as P
from plumbline.operators import relational as R
from plumbline.plans import ordering

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "WITH long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v FROM lineitem" for c in NUMBERS) + ")"
_Q = ", ".join(f"round(quantile_cont(v, {p}), 4) AS {n}" for n, p in P.MARKS.items())
_IQR = "(quantile_cont(v, 0.75) - quantile_cont(v, 0.25))"


@query("prf1_numeric_profile", "PRF-1 PRF-2 PRF-3", f"""{_LONG}, f AS (SELECT col, quantile_cont(v, 0.25) - 1.5 * {_IQR} AS lo, quantile_cont(v, 0.75) + 1.5 * {_IQR} AS hi FROM long GROUP BY col),
o AS (SELECT long.col, count_if(v < lo OR v > hi) AS n_outliers FROM long JOIN f ON long.col = f.col GROUP BY 1)
SELECT long.col, count(*) AS n, count_if(v IS NULL) AS n_missing, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max, round(skewness(v), 4) AS skew, round(kurtosis(v), 4) AS kurtosis,
  count_if(v = 0) AS n_zero, count_if(v < 0) AS n_negative, count(DISTINCT v) AS n_unique, {_Q}, round({_IQR}, 4) AS iqr, round(quantile_cont(v, 0.25) - 1.5 * {_IQR}, 4) AS fence_low, round(quantile_cont(v, 0.75) + 1.5 * {_IQR}, 4) AS fence_high, any_value(n_outliers) AS n_outliers
FROM long JOIN o ON long.col = o.col GROUP BY 1""")
def _(t):
    return _round(P.numeric_profile(t.lineitem, NUMBERS), 4, "min", "max")


@query("prf4_histogram", "PRF-4", f"""{_LONG}, q AS (SELECT col, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM long GROUP BY col)
SELECT long.col, (CASE WHEN v < lo THEN -1 WHEN v > hi THEN 28 ELSE least(floor((v - lo) / ((hi - lo) / 28)), 27) END)::BIGINT AS bin, count(*) AS n FROM long JOIN q ON long.col = q.col GROUP BY 1, 2""")
def _(t):
    return P.clipped_histogram(t.lineitem, NUMBERS)


_TEXT = "WITH long AS (SELECT 'p_brand' AS col, p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part), c AS (SELECT col, v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY 1, 2)"


@query("prf5_categorical_profile", "PRF-5", f"{_TEXT} SELECT col, sum(n)::BIGINT AS n, 0::BIGINT AS n_missing, count(*) AS n_unique, arg_min(v, (-n, v)) AS mode, round(count(*) / sum(n), 6) AS cardinality_ratio, count(*) > 50 AND count(*) / sum(n) > 0.5 AS high_cardinality FROM c GROUP BY 1")
def _(t):
    return _round(P.categorical_profile(t.part, ["p_brand", "p_type", "p_name"]), 6)


@query("prf5_top_values", "PRF-5 SRT-3", f"{_TEXT} SELECT col, rank, v, n, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rank, n / sum(n) OVER (PARTITION BY col) AS share FROM c) WHERE rank <= 12")
def _(t):
    return _round(P.top_values(t.part, ["p_brand", "p_type", "p_name"]), 6)


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query("prf6_pearson", "PRF-6", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def _(t):
    return _round(P.pearson(t.lineitem, NUMBERS), 6)


_RANKS = """WITH k AS (SELECT p_partkey, p_size, p_retailprice, (p_partkey * 37 % 11) AS z FROM part),
r AS (SELECT """ + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in ("p_size", "p_retailprice", "z")) + " FROM k)"


def _keyed(t):
    return t.part.select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") * 37 % 11).alias("z"))


@query("prf7_spearman", "PRF-7", f"{_RANKS} SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(p_size, p_retailprice), 6) AS r FROM r UNION ALL SELECT 'p_size', 'z', round(corr(p_size, z), 6) FROM r UNION ALL SELECT 'p_retailprice', 'z', round(corr(p_retailprice, z), 6) FROM r")
def _(t):
    return _round(P.spearman(_keyed(t), "p_partkey", ["p_size", "p_retailprice", "z"]), 6)


@query("prf8_nonlinearity", "PRF-8", f"{_RANKS}, p AS (SELECT corr(p_size, p_retailprice) AS a, corr(p_size, z) AS b, corr(p_retailprice, z) AS c FROM k), s AS (SELECT corr(p_size, p_retailprice) AS a, corr(p_size, z) AS b, corr(p_retailprice, z) AS c FROM r) SELECT 'p_size' AS a, 'p_retailprice' AS b, round(abs(s.a) - abs(p.a), 6) AS gap FROM p, s UNION ALL SELECT 'p_size', 'z', round(abs(s.b) - abs(p.b), 6) FROM p, s UNION ALL SELECT 'p_retailprice', 'z', round(abs(s.c) - abs(p.c), 6) FROM p, s")
def _(t):
    cs = ["p_size", "p_retailprice", "z"]
    p, s = P.pearson(_keyed(t), cs).withColumnRenamed("r", "p"), P.spearman(_keyed(t), "p_partkey", cs).withColumnRenamed("r", "s")
    return p.join(s, ["a", "b"]).select("a", "b", F.round(F.abs("s") - F.abs("p"), 6).alias("gap"))


@query("prf9_missingness", "PRF-9", """WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price FROM orders)
SELECT '*' AS col, count_if(status IS NULL OR price IS NULL) AS n_missing, round(count_if(status IS NULL OR price IS NULL) / count(*), 6) AS share FROM o UNION ALL SELECT 'o_orderkey', 0, 0 FROM o GROUP BY 1 UNION ALL SELECT 'status', count_if(status IS NULL), round(count_if(status IS NULL) / count(*), 6) FROM o UNION ALL SELECT 'price', count_if(price IS NULL), round(count_if(price IS NULL) / count(*), 6) FROM o""")
def _(t):
    o = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"))
    return _round(P.missingness(o), 6)


@query("prf10_target_association", "PRF-10", f"WITH {SCORED_SQL} SELECT segment, round(avg(label), 6) AS rate, round(avg(price) FILTER (label = 1), 4) AS mean_pos, round(avg(price) FILTER (label = 0), 4) AS mean_neg FROM scored GROUP BY 1")
def _(t):
    y = F.col("label")
    return scored(t).groupBy("segment").agg(F.round(F.avg(y), 6).alias("rate"), F.round(F.avg(F.when(y == 1, F.col("price"))), 4).alias("mean_pos"), F.round(F.avg(F.when(y == 0, F.col("price"))), 4).alias("mean_neg"))


@query("prf11_scorecard", "PRF-11 PRF-12 PRF-13 PRF-14 PRF-15 PRF-16 PRF-17 UDF-1", """
WITH s AS (SELECT 1.0::DOUBLE AS completeness, 1 - (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) / count(*) AS uniqueness, 1 - (count_if(NOT (o_totalprice > 50000)) + count_if(NOT (o_orderstatus IN ('F', 'O')))) / (count(*) * 2.0::DOUBLE) AS validity, 1.0::DOUBLE AS consistency, 1.0::DOUBLE AS timeliness, 1.0::DOUBLE AS cardinality FROM orders),
l AS (SELECT unnest(['completeness', 'uniqueness', 'validity', 'consistency', 'timeliness', 'cardinality', 'overall']) AS dimension, unnest([completeness, uniqueness, validity, consistency, timeliness, cardinality, (completeness + uniqueness + validity + consistency + timeliness + cardinality) / 6]) AS score FROM s)
SELECT dimension, round(score, 6) AS score, CASE WHEN score >= 0.95 THEN 'A' WHEN score >= 0.85 THEN 'B' WHEN score >= 0.7 THEN 'C' ELSE 'D' END AS grade FROM l""")
def _(t):
    return _round(P.scorecard(t.orders, ["o_custkey"], {"price": "o_totalprice > 50000", "status": "o_orderstatus in ('F', 'O')"}, "o_orderdate", ["o_orderstatus", "o_orderpriority"]), 6)


@query("prf19_heat_map", "PRF-19 JOIN-9", "WITH c AS (SELECT isodow(ts) AS dow, hour(ts) AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2) SELECT d.dow, h.hour, coalesce(n, 0)::BIGINT AS n FROM range(1, 8) d(dow) CROSS JOIN range(24) h(hour) LEFT JOIN c ON c.dow = d.dow AND c.hour = h.hour")
def _(t):
    counts = t.events.where("event_type = 'error'").groupBy((F.weekday("ts") + 1).alias("dow"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return R.completed(counts, {"dow": range(1, 8), "hour": range(24)}, {"n": 0})


@query("prf21_domains", "PRF-21", "SELECT 'o_orderstatus' AS col, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def _(t):
    return P.long_text(t.orders, ["o_orderstatus", "o_orderpriority"]).groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))


@query("prf22_skew_log1p", "PRF-22", "SELECT round(skewness(l_extendedprice), 4) AS before, round(skewness(ln(1 + l_extendedprice)), 4) AS after FROM lineitem")
def _(t):
    v = F.col("l_extendedprice")
    return t.lineitem.agg(F.round(P.corrected_skew(v), 4).alias("before"), F.round(P.corrected_skew(F.log1p(v)), 4).alias("after"))


@query("prf23_population", "PRF-23", f"{_LONG} SELECT col, round(median(v), 4) AS median, round(quantile_cont(v, 0.9), 4) AS p90, round(sum(v), 2) AS total FROM long GROUP BY 1")
def _(t):
    long = P.long_numeric(t.lineitem, NUMBERS)
    q = _round(ordering.quantile_columns(long, "v", {"median": 0.5, "p90": 0.9}, ["col"]), 4)
    return q.join(long.groupBy("col").agg(F.round(F.sum("v"), 2).alias("total")), "col")


@query("prf24_class_balance", "PRF-24", f"WITH {SCORED_SQL} SELECT count(*) AS n, sum(label)::BIGINT AS n_pos, round(avg(label), 6) AS rate, round(1 - avg(label), 6) AS flag_nothing_accuracy FROM scored")
def _(t):
    return scored(t).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), F.round(F.avg("label"), 6).alias("rate"), F.round(1 - F.avg("label"), 6).alias("flag_nothing_accuracy"))


def _cohen(c: str) -> str:
    return f"SELECT '{c}' AS col, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, round((avg({c}) FILTER (label = 1) - avg({c}) FILTER (label = 0)) / sqrt(((count(*) FILTER (label = 0) - 1) * var_samp({c}) FILTER (label = 0) + (count(*) FILTER (label = 1) - 1) * var_samp({c}) FILTER (label = 1)) / (count(*) - 2)), 6) AS d FROM scored"


@query("prf25_separability", "PRF-25", f"WITH {SCORED_SQL} {_cohen('price')} UNION ALL {_cohen('score')}")
def _(t):
    return _round(P.separability(scored(t), ["price", "score"], "label"), 6)
