"""Model search: coordinate ascent over discrete grids, cross-validated, with every trial a row of a ledger."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.models import average_precision, fitted, scores

LEDGER = "family string, trial bigint, params string, status string, cv_mean double, cv_std double, message string, accepted boolean"
Metric = Callable[[DataFrame, str, str], float]


@dataclass
class Family:
    """A maker of estimators, where the search begins, and the values that it may try."""

    make: Callable[..., Estimator]
    seed: Mapping[str, object]
    grid: Mapping[str, Sequence] = field(default_factory=dict)


def _text(params: Mapping) -> str:
    return json.dumps(dict(params), sort_keys=True)


def cross_validated(df: DataFrame, make: Callable[[], Estimator], folds: int, metric: Metric, fold: str = "fold", label: str = "label") -> list[float]:
    """The metric on each fold, by a model fitted on the others."""
    out = []
    for f in range(folds):
        model = fitted(make(), df.where(F.col(fold) != f))
        out.append(float(metric(scores(model, df.where(F.col(fold) == f)), label, "score")))
    return out


def search(
    df: DataFrame, families: Mapping[str, Family], folds: int = 3, metric: Metric = average_precision, max_trials: int = 26, patience: int = 2,
    seed: int = 42, path: str | None = None, label: str = "label",
) -> DataFrame:
    """The ledger: family, trial, params (JSON), status, cv_mean, cv_std, message, accepted.

    ``df`` has a ``fold`` column and should be written before.  Each family begins at its seed
    parameters and goes through its keys in a seeded order; the first value that raises the mean is
    taken.  It ends after ``patience`` rounds without a gain, or ``max_trials``.  A trial that fails
    is a row with the reason.  With ``path`` every trial is added to a table there, and trials
    found there are not run again, so an interrupted search goes on where it was.
    """
    spark = df.sparkSession
    done = {(r["family"], r["params"]): r for r in _read(spark, path)} if path else {}
    rows = []
    for name, family in families.items():
        rng, tried, count = np.random.default_rng((seed, sum(map(ord, name)))), {}, 0

        def run(params, name=name, family=family, tried=tried):
            key, before = _text(params), max((v for v in tried.values() if v is not None), default=None)
            status, mean, std, message = "ok", None, None, ""
            if (name, key) in done:
                r = done[name, key]
                status, mean, std, message = r["status"], r["cv_mean"], r["cv_std"], r["message"]
            else:
                try:
                    found = cross_validated(df, lambda: family.make(**params), folds, metric, label=label)
                    mean, std = float(np.mean(found)), float(np.std(found))
                except Exception as e:  # a bad combination is a result of the search
                    status, message = "failed", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]
            tried[key] = mean
            gained = mean is not None and (before is None or mean > before)
            row = (name, len(tried), key, status, mean, std, message, gained)
            rows.append(row)
            if path and (name, key) not in done:
                spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(path)
            return gained

        now = dict(family.seed)
        run(now)
        stale = 0
        while stale < patience and len(tried) < max_trials:
            improved = fresh = False
            for key in rng.permutation(sorted(family.grid)).tolist():
                for value in family.grid[key]:
                    if len(tried) >= max_trials or _text({**now, key: value}) in tried:
                        continue
                    fresh = True
                    if run({**now, key: value}):
                        now, improved = {**now, key: value}, True
                        break
            stale = 0 if improved else stale + 1
            if not fresh:
                break
    return spark.createDataFrame(rows, LEDGER)


def _read(spark: SparkSession, path: str) -> list:
    """The trials of an earlier run; a trial's row is small, and their number is bounded by the search."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(path).collect()
    except AnalysisException:  # nothing there yet
        return []


def leaderboard(ledger: DataFrame, train: DataFrame, test: DataFrame, families: Mapping[str, Family], metric: Metric = average_precision, gap: float = 0.03, label: str = "label") -> DataFrame:
    """(family, params, trials, failed, seed_score, cv_mean, holdout, improvement, gap, overfit): each family's best, refitted on ``train`` and judged once on ``test``."""
    rows = []
    trials = ledger.orderBy("family", "trial").collect()
    for name, family in families.items():
        own = [r for r in trials if r["family"] == name]
        fine = [r for r in own if r["cv_mean"] is not None]
        if not fine:
            rows.append((name, None, len(own), len(own), None, None, None, None, None, None))
            continue
        best = max(fine, key=lambda r: (r["cv_mean"], -r["trial"]))
        held = float(metric(scores(fitted(family.make(**json.loads(best["params"])), train), test), label, "score"))
        first = own[0]["cv_mean"]
        off = best["cv_mean"] - held
        rows.append((name, best["params"], len(own), len(own) - len(fine), first, best["cv_mean"], held, None if first is None else best["cv_mean"] - first, off, off > gap))
    return ledger.sparkSession.createDataFrame(rows, "family string, params string, trials bigint, failed bigint, seed_score double, cv_mean double, holdout double, improvement double, gap double, overfit boolean")
