"""Evaluation, decisions and fairness over score tables that follow from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query
from plumbline.catalog.trips import KEPT_SQL, SCORED_SQL, kept, scored
from plumbline.operators import decisions as D
from plumbline.operators import evaluation as E
from plumbline.plans import ordering
from plumbline.session import durable

_TABLE = f"""
WITH {SCORED_SQL}, s AS (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM scored GROUP BY score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (ORDER BY score DESC)),
t AS (SELECT sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n FROM s)"""
_CONF = "count_if(label = 1 AND score >= 0.5) AS tp, count_if(label <> 1 AND score >= 0.5) AS fp, count_if(label <> 1 AND score < 0.5) AS tn, count_if(label = 1 AND score < 0.5) AS fn"


def _round(df, digits: int, *keep: str):
    return df.select(*[F.col(c) if c in keep or kind not in ("double", "float") else F.round(c, digits).alias(c) for c, kind in df.dtypes])


@query("cls1_confusion", "CLS-1", f"WITH {SCORED_SQL} SELECT {_CONF} FROM scored")
def _(t):
    return E.confusion(scored(t), 0.5)


@query("cls2_threshold_metrics", "CLS-2", f"""
WITH {SCORED_SQL}, c AS (SELECT {_CONF} FROM scored)
SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
  round((tp + fn) / (tp + fp + tn + fn), 6) AS prevalence, round(greatest(tp + fn, tn + fp) / (tp + fp + tn + fn), 6) AS majority_accuracy, least(tp + fn, tn + fp) / (tp + fp + tn + fn) < 0.2 AS accuracy_misleading FROM c""")
def _(t):
    return _round(E.threshold_metrics(E.confusion(scored(t), 0.5)), 6)


@query("cls3_roc_auc", "CLS-3 CLS-4 CLS-14", f"""{_TABLE}
SELECT p::BIGINT AS n_pos, n::BIGINT AS n_neg, round((SELECT sum(neg * (tp - pos / 2.0::DOUBLE)) FROM c) / (p * n), 6) AS roc_auc, round((SELECT sum(pos * tp::DOUBLE / (tp + fp)) FROM c) / p, 6) AS average_precision,
  (SELECT sum(neg * (tp - pos / 2.0::DOUBLE)) FROM c) / (p * n) < 0.5 AS inverted, round((SELECT sum(pos * tp::DOUBLE / (tp + fp)) FROM c) / p / (p / (p + n)), 6) AS lift FROM t""")
def _(t):
    return _round(E.ranking_metrics(E.score_table(scored(t))), 6)


@query("cls5_losses", "CLS-5", f"""WITH {SCORED_SQL}, q AS (SELECT label, score, greatest(1e-15, least(1 - 1e-15, score)) AS g FROM scored)
SELECT round(avg((score - label) * (score - label)), 6) AS brier, round(avg(-(label * ln(g) + (1 - label) * ln(1 - g))), 6) AS log_loss FROM q""")
def _(t):
    return _round(E.probability_losses(scored(t)), 6)


@query("cls6_curves", "CLS-6 SMP-2", f"""{_TABLE}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC) - 1 AS i, greatest(count(*) OVER () - 1, 1) AS last FROM c)
SELECT score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, round(tp::DOUBLE / (tp + fp), 6) AS precision FROM r, t WHERE round(round(i * 219 / last) * last / 219) = i""")
def _(t):
    return _round(E.curves(E.score_table(scored(t))), 6, "score")


@query("cls7_sweep", "CLS-7", f"""
WITH {SCORED_SQL}, g AS (SELECT 0.01::DOUBLE + (0.99::DOUBLE - 0.01::DOUBLE) * i / 100 AS threshold FROM range(101) r(i)), tot AS (SELECT sum(label) AS p FROM scored),
c AS (SELECT threshold, count_if(label = 1 AND score >= threshold) AS tp, count_if(label <> 1 AND score >= threshold) AS fp FROM g, scored GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, tp, fp, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END AS precision, round(tp / p, 6) AS recall, round(2 * tp / (tp + fp + p), 6) AS f1, round((p - tp) * 5.0::DOUBLE + fp * 1.0::DOUBLE, 2) AS cost FROM c, tot""")
def _(t):
    return _round(E.sweep(scored(t), 5.0, 1.0), 6)


_CAL = f"""WITH {SCORED_SQL}, e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM scored),
b AS (SELECT len(list_filter(q, lambda x: x < score))::BIGINT AS bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS rate FROM scored, e GROUP BY 1)"""


@query("cls8_calibration", "CLS-8", f"{_CAL} SELECT bin, n, round(mean_score, 6) AS mean_score, round(rate, 6) AS rate, round(abs(mean_score - rate), 6) AS gap FROM b")
def _(t):
    return _round(E.calibration(scored(t)), 6)


@query("cls8_calibration_error", "CLS-8", f"{_CAL} SELECT round(avg(abs(mean_score - rate)), 6) AS ece, round(sum(abs(mean_score - rate) * n) / sum(n), 6) AS ece_weighted FROM b")
def _(t):
    return _round(E.calibration_error(E.calibration(scored(t))), 6)


_RANKED = f"WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM scored), tot AS (SELECT count(*) AS n, sum(label) AS p FROM scored)"


@query("cls9_gain", "CLS-9", f"""{_RANKED}, d AS (SELECT i / 10.0::DOUBLE AS share, greatest(1, floor(n * (i / 10.0::DOUBLE))::BIGINT) AS k FROM range(1, 11) g(i), tot)
SELECT share, k, sum(label)::BIGINT AS hits, round(sum(label) / p, 6) AS recall, round(sum(label) / k, 6) AS precision, round(sum(label) / k / (p / n), 6) AS lift FROM r JOIN d ON rn <= k, tot GROUP BY share, k, p, n""")
def _(t):
    return _round(E.gain(scored(t), "id", [i / 10 for i in range(1, 11)]), 6)


@query("cls10_histogram", "CLS-10", f"WITH {SCORED_SQL} SELECT label, least(floor(score / (1.0::DOUBLE / 24)), 23)::BIGINT AS bin, count(*) AS n FROM scored GROUP BY 1, 2")
def _(t):
    return E.histogram(scored(t), "score", 0.0, 1.0, 24, ["label"])


@query("cls12_heuristic", "CLS-12", f"WITH {SCORED_SQL} SELECT id, round(0.6 * (price > 200000)::INT + 0.4 * (segment = 'MACHINERY')::INT, 4)::DOUBLE AS h FROM scored")
def _(t):
    h = 0.6 * (F.col("price") > 200000).cast("int") + 0.4 * (F.col("segment") == "MACHINERY").cast("int")
    return scored(t).select("id", F.round(h.cast("double"), 4).alias("h"))


@query("cls13_finite", "CLS-13", f"WITH {SCORED_SQL} SELECT 'a' AS detector, count(*) AS n, 0::BIGINT AS n_bad, true AS usable FROM scored UNION ALL SELECT 'b', count(*), count_if(id % 5 = 0), count_if(id % 5 = 0) = 0 FROM scored")
def _(t):
    b = F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("score"))
    return E.finite_scores(scored(t).select(F.col("score").alias("a"), b.alias("b")), ["a", "b"])


def predicted(t):
    return kept(t).select(
        "l_orderkey", "pickup_borough", "pickup_zone", "month", F.col("fare").alias("y"), (F.col("distance") * 1500.0).alias("p"),
        (F.col("distance") * 1500.0 - 12000).alias("lo"), (F.col("distance") * 1500.0 + 12000).alias("hi"), "pickup", "l_linenumber", "l_partkey")


_PRED = KEPT_SQL + ", pred AS (SELECT l_orderkey, l_linenumber, l_partkey, pickup_borough, month, pickup, fare AS y, distance * 1500.0::DOUBLE AS p, distance * 1500.0::DOUBLE - 12000 AS lo, distance * 1500.0::DOUBLE + 12000 AS hi FROM kept)"
_REG = """count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs((y - p) / y)) FILTER (abs(y) > 1e-6), 4) AS mape, round(avg((abs(y) > 1e-6)::INT), 4) AS mape_coverage,
  round(avg(y - p), 4) AS bias, round(stddev_pop(y - p), 4) AS residual_std, round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2"""


@query("reg1_metrics", "REG-1", f"WITH {_PRED} SELECT {_REG} FROM pred")
def _(t):
    return _round(E.regression(predicted(t)), 4)


@query("reg1_error_quantiles", "REG-1", f"WITH {_PRED} SELECT round(median(abs(y - p)), 4) AS median_error, round(quantile_cont(abs(y - p), 0.9), 4) AS p90_error FROM pred")
def _(t):
    errors = predicted(t).select(F.abs(F.col("y") - F.col("p")).alias("e"))
    return _round(ordering.quantile_columns(errors, "e", {"median_error": 0.5, "p90_error": 0.9}), 4)


@query("reg2_residual_histogram", "REG-2", f"""WITH {_PRED}, e AS (SELECT y - p AS e FROM pred), m AS (SELECT min(e) AS lo, max(e) AS hi FROM e)
SELECT least(floor((e - lo) / ((hi - lo) / 40)), 39)::BIGINT AS bin, count(*) AS n FROM e, m GROUP BY 1""")
def _(t):
    e = predicted(t).select((F.col("y") - F.col("p")).alias("e"))
    lo, hi = e.agg(F.min("e"), F.max("e")).first()
    return E.histogram(e, "e", lo, hi, 40)


@query("reg3_quantile_calibration", "REG-3", f"""WITH {_PRED}, q AS (SELECT quantile_cont(y, [{', '.join(f'{i / 20:.2f}' for i in range(1, 20))}]) AS a, quantile_cont(p, [{', '.join(f'{i / 20:.2f}' for i in range(1, 20))}]) AS b FROM pred)
SELECT round(i / 20.0::DOUBLE, 2) AS prob, round(a[i], 4) AS actual, round(b[i], 4) AS predicted FROM q, range(1, 20) g(i)""")
def _(t):
    probs = [round(i / 20, 2) for i in range(1, 20)]
    p = predicted(t)
    a = ordering.quantiles(p, "y", probs).select("prob", F.round("quantile", 4).alias("actual"))
    return a.join(ordering.quantiles(p, "p", probs).select("prob", F.round("quantile", 4).alias("predicted")), "prob")


@query("reg5_by_segment", "REG-5", f"WITH {_PRED} SELECT pickup_borough, {_REG} FROM pred GROUP BY 1 HAVING count(*) >= 40")
def _(t):
    return _round(E.regression(predicted(t), by=["pickup_borough"]), 4).where("n >= 40")


@query("reg6_by_month", "REG-6", f"WITH {_PRED} SELECT month, {_REG} FROM pred GROUP BY 1")
def _(t):
    return _round(E.regression(predicted(t), by=["month"]), 4)


_INT = """count(*) AS n, round(avg((y >= lo AND y <= hi)::INT), 6) AS coverage, round(avg(hi - lo), 4) AS mean_width, round(avg(greatest(0.1::DOUBLE * (y - lo), (0.1::DOUBLE - 1) * (y - lo))), 4) AS pinball_low,
  round(avg(greatest(0.9::DOUBLE * (y - hi), (0.9::DOUBLE - 1) * (y - hi))), 4) AS pinball_high, count_if(lo > hi) AS n_crossed, round(avg((y >= lo AND y <= hi)::INT) - (1 - 0.2::DOUBLE), 6) AS gap,
  CASE WHEN abs(avg((y >= lo AND y <= hi)::INT) - (1 - 0.2::DOUBLE)) <= 0.05 THEN 'calibrated' WHEN avg((y >= lo AND y <= hi)::INT) < 0.8 THEN 'too narrow' ELSE 'too wide' END AS verdict"""


def _intervals(df):
    out = E.intervals(df, 0.2)
    return out.select(*[F.round(c, 6 if c in ("coverage", "gap") else 4).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


@query("int1_coverage", "INT-1 INT-2", f"WITH {_PRED} SELECT {_INT} FROM pred")
def _(t):
    return _intervals(predicted(t))


_CUT = "TIMESTAMP '1999-01-01'"


@query("int3_conformal", "INT-3 INT-4 SPL-11", f"""WITH {_PRED}, cal AS (SELECT greatest(lo - y, y - hi) AS e FROM pred WHERE pickup < {_CUT}), n AS (SELECT count(*) AS n FROM cal),
o AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i FROM cal), a AS (SELECT min(e) AS adj FROM o, n WHERE i >= ceil(least(1.0::DOUBLE, 0.8::DOUBLE * (1 + 1.0::DOUBLE / n)) * (n - 1))),
late AS (SELECT y, least(lo - adj, hi + adj) AS lo, greatest(lo - adj, hi + adj) AS hi FROM pred, a WHERE pickup >= {_CUT}) SELECT {_INT} FROM late""")
def _(t):
    p, cut = durable(predicted(t).select("y", "p", "lo", "hi", "pickup")), F.lit("1999-01-01").cast("timestamp_ntz")
    adjustment = E.conformal_adjustment(p.where(F.col("pickup") < cut), 0.2)
    return _intervals(E.conformal(p.where(F.col("pickup") >= cut), adjustment))


@query("dec4_economics", "DEC-4 DEC-5 DEC-10", f"""WITH {SCORED_SQL} SELECT id, round(score * 0.3 * 500 - 40, 4)::DOUBLE AS expected_value, round(40 / 150.0::DOUBLE, 6) AS break_even,
  CASE WHEN score * 0.3::DOUBLE * 500 - 40 > 0 THEN 'contact' ELSE 'leave' END AS action, CASE WHEN score >= 0.66 THEN 'high' WHEN score >= 0.33 THEN 'medium' ELSE 'low' END AS band FROM scored""")
def _(t):
    out = D.expected_value(scored(t), D.Economics())
    return out.select("id", F.round("expected_value", 4).alias("expected_value"), F.round("break_even", 6).alias("break_even"), "action", D.bands(F.col("score")).alias("band"))


@query("dec6_campaign", "DEC-6", f"""{_RANKED}, d AS (SELECT i / 20.0::DOUBLE AS share, greatest(1, floor(n * (i / 20.0::DOUBLE))::BIGINT) AS k FROM range(1, 21) g(i), tot),
h AS (SELECT share, k, p, n, sum(label)::BIGINT AS hits FROM r JOIN d ON rn <= k, tot GROUP BY share, k, p, n)
SELECT share, k, hits, round(hits / p, 6) AS recall, round(hits / k, 6) AS precision, round(k * 40.0::DOUBLE, 2) AS cost, round(hits * 0.3::DOUBLE * 500, 2) AS saved, round(hits * 0.3::DOUBLE * 500 - k * 40, 2) AS net, round((hits * 0.3::DOUBLE * 500 - k * 40) / (k * 40.0::DOUBLE), 6) AS roi FROM h""")
def _(t):
    out = D.campaign(scored(t), "id", D.Economics(), [i / 20 for i in range(1, 21)])
    return out.select("share", "k", "hits", *[F.round(c, 6).alias(c) for c in ("recall", "precision")], *[F.round(c, 2).alias(c) for c in ("cost", "saved", "net")], F.round("roi", 6).alias("roi"))


@query("dec7_segment_rates", "DEC-7 FAIR-5", f"WITH {SCORED_SQL} SELECT segment, count(*) AS n, round(avg(label), 6) AS rate FROM scored GROUP BY 1 HAVING count(*) >= 50")
def _(t):
    return scored(t).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("rate")).where("n >= 50")


@query("dec8_alert_budget", "DEC-8", f"""{_RANKED}, d AS (SELECT unnest([25, 50, 100, 200, 400, 800, 1600]) AS budget)
SELECT budget::BIGINT AS budget, sum(label)::BIGINT AS tp, (count(*) - sum(label))::BIGINT AS fp, round(sum(label) / budget, 6) AS precision, round(sum(label) / p, 6) AS recall, (p - sum(label))::BIGINT AS missed, budget * 0.1::DOUBLE AS hours FROM r JOIN d ON rn <= budget, tot GROUP BY budget, p""")
def _(t):
    ranked = ordering.row_numbers(scored(t).select("id", "label", "score"), [-F.col("score"), F.col("id")])
    total = scored(t).agg(F.sum("label")).first()[0]
    budgets = F.array(*[F.lit(b).cast("bigint") for b in (25, 50, 100, 200, 400, 800, 1600)])
    rows = ranked.where("rn <= 1600").select("label", "rn", F.explode(budgets).alias("budget")).where("rn <= budget")
    out = rows.groupBy("budget").agg(F.sum("label").alias("tp"), F.count_if(F.col("label") != 1).alias("fp"))
    return out.select("budget", "tp", "fp", F.round(F.col("tp") / F.col("budget"), 6).alias("precision"), F.round(F.col("tp") / total, 6).alias("recall"), (F.lit(total) - F.col("tp")).alias("missed"), (F.col("budget") * F.lit(0.1)).alias("hours"))


@query("dec9_family_recall", "DEC-9", f"{_RANKED} SELECT segment, sum(label)::BIGINT AS n_pos, sum(CASE WHEN rn <= 1000 THEN label ELSE 0 END)::BIGINT AS found, round(sum(CASE WHEN rn <= 1000 THEN label ELSE 0 END) / sum(label), 6) AS recall FROM r GROUP BY 1")
def _(t):
    ranked = ordering.row_numbers(scored(t).select("id", "label", "score", "segment"), [-F.col("score"), F.col("id")])
    found = F.sum(F.when(F.col("rn") <= 1000, F.col("label")).otherwise(0))
    return ranked.groupBy("segment").agg(F.sum("label").alias("n_pos"), found.alias("found")).withColumn("recall", F.round(F.col("found") / F.col("n_pos"), 6))


def _rates_sql(by: str) -> str:
    return f"""r AS (SELECT {by}, tp, fp, tn, fn, (tp + fp + tn + fn) AS n, (tp + fn) / (tp + fp + tn + fn) AS base_rate, (tp + fp) / (tp + fp + tn + fn) AS selection_rate, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr, tn / (fp + tn) AS tnr, fn / (tp + fn) AS fnr, tp / (tp + fp) AS precision, (tp + tn) / (tp + fp + tn + fn) AS accuracy
  FROM (SELECT {by}, {_CONF} FROM scored GROUP BY 1) WHERE tp + fp + tn + fn >= 30)"""


_R6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("base_rate", "selection_rate", "tpr", "fpr", "tnr", "fnr", "precision", "accuracy"))


@query("fair1_group_rates", "FAIR-1", f"WITH {SCORED_SQL}, {_rates_sql('segment')} SELECT segment, tp, fp, tn, fn, n, {_R6} FROM r")
def _(t):
    return _round(D.group_rates(scored(t), "segment", 0.5, 30), 6)


_REPORT = """count(*) AS n_groups, round(max(selection_rate), 6) AS reference_rate, round(min(selection_rate) / max(selection_rate), 6) AS disparate_impact, min(selection_rate) / max(selection_rate) >= 0.8 AS four_fifths,
  round(max(selection_rate) - min(selection_rate), 6) AS parity_difference, round(max(tpr) - min(tpr), 6) AS opportunity_difference, round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS odds_difference, round(max(base_rate) - min(base_rate), 6) AS base_rate_difference"""


@query("fair2_group_report", "FAIR-2", f"WITH {SCORED_SQL}, {_rates_sql('segment')} SELECT {_REPORT} FROM r")
def _(t):
    return _round(D.group_report(D.group_rates(scored(t), "segment", 0.5, 30)), 6)


@query("fair3_audit", "FAIR-3", f"SELECT 'segment' AS attribute, * FROM (WITH {SCORED_SQL}, {_rates_sql('segment')} SELECT {_REPORT} FROM r) UNION ALL SELECT 'region', * FROM (WITH {SCORED_SQL}, {_rates_sql('region')} SELECT {_REPORT} FROM r)")
def _(t):
    one = lambda by: _round(D.group_report(D.group_rates(scored(t), by, 0.5, 30)), 6).select(F.lit(by).alias("attribute"), "*")
    return one("segment").unionByName(one("region"))


@query("fair4_equalised", "FAIR-4", f"""WITH {SCORED_SQL}, g AS (SELECT i, 0.05::DOUBLE + (0.95::DOUBLE - 0.05::DOUBLE) * i / 80 AS threshold FROM range(81) r(i)), o AS (SELECT count_if(label = 1 AND score >= 0.5) / count_if(label = 1) AS tpr FROM scored),
a AS (SELECT segment, i, threshold, count_if(score >= threshold) / count(*) AS tpr FROM scored, g WHERE label = 1 GROUP BY 1, 2, 3),
b AS (SELECT a.*, abs(a.tpr - o.tpr) AS gap, row_number() OVER (PARTITION BY segment ORDER BY abs(a.tpr - o.tpr), i) AS rn FROM a, o)
SELECT segment, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(gap, 6) AS gap FROM b WHERE rn = 1""")
def _(t):
    return _round(D.equalised(scored(t), "segment", 0.5), 6)


@query("reg4_scatter_sample", "REG-4", f"WITH {_PRED} SELECT l_orderkey, l_linenumber, l_partkey, y, p FROM pred ORDER BY ('0x' || substr(md5('42:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey), 1, 15))::BIGINT, l_orderkey, l_linenumber, l_partkey, y, p LIMIT 1200")
def _(t):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    cs = ["l_orderkey", "l_linenumber", "l_partkey", "y", "p"]
    return predicted(t).select(*cs).orderBy(ordering.portable_hash(key), *cs).limit(1200)


def _folds(t):
    from plumbline.operators import splits

    return durable(splits.folds(scored(t).select("id", F.col("label").cast("double").alias("label"), F.col("score").alias("x")), "id", "label", 3))


def _calibrated(t):
    """Scores of each fold by isotonic and by sigmoid calibration on the other two."""
    from plumbline.operators import models

    folds = _folds(t)
    out = models.cross_fitted(folds, lambda: D.Isotonic("x", "label", "isotonic"), lambda m, df: m.transform(df))
    return models.cross_fitted(out, lambda: models.pipeline("logistic", ["x"], regParam=0.0), lambda m, df: models.scores(m, df, "sigmoid"))


@query("dec1_isotonic", "DEC-1")
def _(t):
    return _calibrated(t).select("id", "label", "x", F.col("isotonic").alias("calibrated"))


@query("dec2_sigmoid", "DEC-2")
def _(t):
    return _calibrated(t).select("id", "label", "x", F.col("sigmoid").alias("calibrated"))


@query("dec3_comparison", "DEC-3")
def _(t):
    return D.calibration_comparison(_calibrated(t), {"raw": "x", "isotonic": "isotonic", "sigmoid": "sigmoid"})


@query("scr4_churn_scoring", "SCR-4", f"WITH {SCORED_SQL} SELECT id, score >= 40 / (40 + 500 * 0.3::DOUBLE) AS contact, round(score * 150.0::DOUBLE - 40, 4) AS expected_value FROM scored")
def _(t):
    e = D.Economics()
    out = D.expected_value(scored(t), e)
    return out.select("id", (F.col("score") >= e.threshold).alias("contact"), F.round("expected_value", 4).alias("expected_value"))


@query("scr10_nearest_budget", "SCR-10", f"WITH {SCORED_SQL}, s AS (SELECT segment, count_if(score >= 0.9) AS n FROM scored GROUP BY 1), b AS (SELECT unnest([25, 50, 100, 200, 400, 800, 1600])::BIGINT AS budget) SELECT segment, n, arg_min(budget, (abs(budget - n), budget)) AS budget FROM s, b GROUP BY 1, 2")
def _(t):
    s = scored(t).groupBy("segment").agg(F.count_if(F.col("score") >= 0.9).alias("n"))
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(b) - F.col("n")).alias("d"), F.lit(b).cast("bigint").alias("budget")) for b in (25, 50, 100, 200, 400, 800, 1600)]))
    return s.select("segment", "n", near["budget"].alias("budget"))
