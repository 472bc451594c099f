"""Every query with an oracle gives the oracle's rows on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from plumbline import catalog

catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(tuple(canonical(r[i]) for i in order) for r in result.fetchall())
    assert got == expected


def _shares(*columns):
    return lambda rows: all(0 <= r[c] <= 1 for r in rows for c in columns)


def _once(key, n):
    return lambda rows: len({r[key] for r in rows}) == len(rows) == n


def _both(*checks):
    return lambda rows: all(c(rows) for c in checks)


#: What must hold of the queries that SQL cannot express, on the smallest tables: 1500 orders, 150 customers, 1000 events, 500 vectors.
PROPERTIES = {
    "ano1_isolation_forest": _both(_once("event_id", 1000), _shares("score"), lambda rows: all(r["path"] > 0 for r in rows)),
    "ano3_one_class": _both(_once("event_id", 1000), lambda rows: abs(sum(r["outside"] for r in rows) / 1000 - 0.03) <= 0.01 and all(r["outside"] == (r["score"] > 0) for r in rows)),
    "ano4_robust_envelope": _both(_once("event_id", 1000), lambda rows: all(r["distance"] >= 0 for r in rows) and sorted(r["distance"] for r in rows)[500] < 10),
    "cls11_report": lambda rows: {r["section"] for r in rows} >= {"ranking", "threshold", "losses", "curves", "sweep", "calibration", "gain", "histogram"},
    "dec1_isotonic": _both(_once("id", 1500), _shares("calibrated")),
    "dec2_sigmoid": _both(_once("id", 1500), _shares("calibrated")),
    "dec3_comparison": lambda rows: len(rows) == 3 and all(abs(r["mean_predicted"] - r["observed"]) < 0.02 for r in rows if r["stage"] != "raw") and len({r["n"] for r in rows}) == 1,
    "exp1_permutation_importance": lambda rows: {r["feature"] for r in rows} == {"a", "b"} and all(r["std_drop"] > 0 for r in rows),
    "exp2_partial_dependence": _both(_once("value", 24), _shares("mean_score")),
    "fc6_horizon_study": lambda rows: [r["horizon"] for r in sorted(rows)] == [1, 6, 24, 168] and all(int(c[4:]) >= r["horizon"] for r in rows for c in r["features"].split(",") if c.startswith("lag_")),
    "int5_band_report": lambda rows: rows[0]["n_crossed"] == 0 and abs(rows[0]["coverage"] - 0.8) <= 0.05,
    "int5_quantile_forest": lambda rows: len(rows) > 500 and all(r["q10"] <= r["q50"] <= r["q90"] for r in rows),
    "mdl10_greedy_ensemble": _both(_once("id", 1500), _shares("blend", "metric")),
    "mdl12_stacking": _both(_once("id", 1500), _shares("blend", "stacked")),
    "mdl13_correlation": lambda rows: len(rows) == 1 and all(-1 <= rows[0][c] <= 1 for c in ("pearson", "spearman")),
    "mdl14_distillation": _both(_once("id", 1500), _shares("decision", "repeated", "p_tree")),
    "mdl14_fidelity": _both(_shares("agreement", "auc", "auc_tree"), lambda rows: len(rows) == 1),
    "mdl14_rules": lambda rows: 1 <= len(rows) <= 16 and sum(r["n"] for r in rows) == 1500,
    "mdl15_holdout": _both(_once("family", 3), _shares("roc_auc", "average_precision"), lambda rows: len({(r["n_pos"], r["n_neg"]) for r in rows}) == 1),
    "mdl17_saved_model": lambda rows: len(rows) > 200 and all(r["same"] for r in rows),
    "mdl1_logistic": _both(_once("id", 299), _shares("p")),
    "mdl2_forest": lambda rows: abs(sum(r["importance"] for r in rows) - 1) < 1e-9,
    "mdl3_boosting": _both(_once("id", 299), _shares("p")),
    "mdl5_leaderboard": lambda rows: len(rows) == 2 and all(r["cv_mean"] >= r["seed_score"] and r["overfit"] == (r["gap"] > 0.03) for r in rows),
    "mdl5_search": lambda rows: {r["status"] for r in rows} == {"ok", "failed"} and all((r["cv_mean"] is None) == (r["status"] == "failed") for r in rows),
    "mdl9_out_of_fold": _both(_once("id", 1500), _shares("p_logistic", "p_boosting")),
    "prf18_full_profile": lambda rows: {r["section"] for r in rows} >= {"shape", "types", "numeric", "categorical", "pearson", "spearman", "missing", "quality", "target"},
    "scr9_scored_events": lambda rows: len({r["event_id"] for r in rows}) >= 20 and len(rows) == 3 * len({r["event_id"] for r in rows}) and {r["place"] for r in rows} == {1, 2, 3},
    "seg12_gap_statistic": lambda rows: [r["k"] for r in sorted(rows)] == list(range(2, 9)) and sum(r["chosen"] for r in rows) == 1 and all(r["s_k"] >= 0 for r in rows),
    "seg13_stability": lambda rows: len(rows) == 6 and all(-1 <= r["ari"] <= 1 and 90 <= r["n"] <= 150 for r in rows),
    "seg19_pca": _both(_once("vec_id", 500), lambda rows: all(r["error"] > -1e-6 for r in rows)),
    "seg4_k_means": _both(_once("customer", 150), _shares("distance_ratio"), lambda rows: len({r["cluster"] for r in rows}) == 4),
    "seg4_k_sweep": lambda rows: [r["k"] for r in sorted(rows)] == list(range(2, 11)) and all(a["inertia"] >= b["inertia"] for a, b in zip(sorted(rows), sorted(rows)[1:])) and sum(r["chosen"] for r in rows) == 1,
    "seg5_gaussian_mixture": _both(_once("customer", 150), lambda rows: {r["cluster"] for r in rows} <= {0, 1, 2}),
    "seg6_hierarchical": _both(_once("customer", 150), lambda rows: {r["cluster"] for r in rows} <= {0, 1, 2, 3}),
    "seg8_eps_sweep": lambda rows: all(a["eps"] <= b["eps"] and a["noise"] >= b["noise"] for a, b in zip(sorted(rows), sorted(rows)[1:])) and sum(r["chosen"] for r in rows) <= 1,
    "ts5_partial_autocorrelation": lambda rows: len(rows) == 25 and rows[0]["pacf"] == 1.0 and all(abs(r["pacf"]) <= 1 for r in rows),
}


def test_every_query_has_an_oracle_or_a_property():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(PROPERTIES)


@pytest.mark.parametrize("name", sorted(PROPERTIES))
def test_query_without_oracle(spark, sf_dir, name):
    rows = catalog.QUERIES[name](spark, sf_dir).collect()
    assert rows and PROPERTIES[name](rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
