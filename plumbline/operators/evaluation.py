"""Evaluation of score, prediction and interval tables.

Everything about a classifier's scores comes from one table of distinct scores with their
positives and negatives, and the running counts from the highest score down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans import ordering


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def score_table(df: DataFrame, label: str = "label", score: str = "score", partitions: int | None = None) -> DataFrame:
    """(score, pos, neg, tp, fp): tp and fp count the rows with this score or a higher one."""
    y = F.col(label)
    counts = df.where(F.col(score).isNotNull() & ~F.isnan(score) & y.isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    return ordering.cumulate(counts, [-F.col("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, partitions=partitions)


def totals(table: DataFrame) -> tuple[int, int]:
    """Positives and negatives."""
    p, n = table.agg(F.sum("pos"), F.sum("neg")).first()
    return p or 0, n or 0


def ranking_metrics(table: DataFrame) -> DataFrame:
    """One row: n_pos, n_neg, roc_auc (ties averaged), average_precision (steps), inverted, lift."""
    p, n = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = table.agg(p.alias("n_pos"), n.alias("n_neg"), F.when((p > 0) & (n > 0), wins / (p * n)).alias("roc_auc"), F.when(p > 0, steps / p).alias("average_precision"))
    base = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    return out.withColumns({"inverted": F.col("roc_auc") < 0.5, "lift": F.col("average_precision") / base})


def confusion(df: DataFrame, threshold: float, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn at a threshold (inclusive), per group if asked; rows without a label or with a null or NaN score are in none."""
    y, hit = F.col(label) == 1, F.when(~F.isnan(score), F.col(score) >= threshold)
    return df.groupBy(*by).agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(~y & ~hit).alias("tn"), F.count_if(y & ~hit).alias("fn"))


def threshold_metrics(c: DataFrame) -> DataFrame:
    """Adds the usual rates to a table with tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    d = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return c.withColumns({
        "precision": precision, "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, n),
        "balanced_accuracy": (recall + specificity) / 2, "mcc": ratio(tp.cast("double") * tn - fp.cast("double") * fn, d),
        "prevalence": ratio(tp + fn, n), "majority_accuracy": ratio(F.greatest(tp + fn, tn + fp), n),
        "accuracy_misleading": ratio(F.least(tp + fn, tn + fp), n) < 0.2,
    })


def sweep(df: DataFrame, cost_fn: float, cost_fp: float, label: str = "label", score: str = "score", points: int = 101, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(threshold, tp, fp, precision, recall, f1, cost) at ``points`` even thresholds; one scan."""
    marks = [low + (high - low) * i / (points - 1) for i in range(points)]
    grid = F.array(*[F.lit(m) for m in marks])
    y = F.col(label)
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    below = counts.select(F.size(F.filter(grid, lambda m: m <= F.col("s"))).alias("k"), "pos", "neg").groupBy("k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, n = totals(below)
    # At most points + 1 rows from here on.
    reached = below.select("pos", "neg", F.explode(F.when(F.col("k") > 0, F.sequence(F.lit(1), F.greatest("k", F.lit(1))))).alias("i"))
    at = reached.groupBy("i").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    frame = df.sparkSession.range(1, points + 1).select(F.col("id").cast("int").alias("i"), F.element_at(grid, F.col("id").cast("int")).alias("threshold"))
    out = frame.join(at, "i", "left").fillna({"tp": 0, "fp": 0})
    tp, fp = F.col("tp"), F.col("fp")
    return out.select(
        "threshold", "tp", "fp", ratio(tp, tp + fp).alias("precision"), ratio(tp, F.lit(p)).alias("recall"),
        ratio(2 * tp, tp + fp + F.lit(p)).alias("f1"), ((F.lit(p) - tp) * cost_fn + fp * cost_fp).alias("cost"))


def probability_losses(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Brier score and log loss (clipped at 1e-15)."""
    y, s = F.col(label), F.col(score)
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), s))
    return df.agg(F.avg((s - y) * (s - y)).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))


def calibration(df: DataFrame, bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """(bin, n, mean_score, rate, gap): quantile edges, right-closed; empty bins are absent."""
    edges = sorted(set(ordering.quantile_list(df, score, [i / bins for i in range(bins + 1)])))
    inner = edges[1:-1]
    b = F.size(F.filter(F.array(*[F.lit(e) for e in inner]), lambda e: e < F.col(score))) if inner else F.lit(0)
    out = df.groupBy(b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("rate"))
    return out.withColumn("gap", F.abs(F.col("mean_score") - F.col("rate")))


def calibration_error(bins: DataFrame) -> DataFrame:
    """The unweighted mean gap over bins, and the one weighted by rows."""
    return bins.agg(F.avg("gap").alias("ece"), (F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece_weighted"))


def gain(df: DataFrame, tie: str, shares: Sequence[float], label: str = "label", score: str = "score") -> DataFrame:
    """(share, k, hits, recall, precision, lift) of the first max(1, int(n * share)) rows by score."""
    ranked = ordering.row_numbers(df.select(label, score, tie), [-F.col(score), F.col(tie)])
    n, p = df.agg(F.count(F.lit(1)), F.sum(F.col(label))).first()
    ks = {s: max(1, int(n * s)) for s in shares}
    sums = ranked.agg(*[F.sum(F.when(F.col("rn") <= k, F.col(label)).otherwise(0)).alias(f"h{i}") for i, k in enumerate(ks.values())])
    rows = [F.struct(F.lit(float(s)).alias("share"), F.lit(k).cast("bigint").alias("k"), F.col(f"h{i}").cast("bigint").alias("hits")) for i, (s, k) in enumerate(ks.items())]
    out = sums.select(F.inline(F.array(*rows)))
    return out.select("share", "k", "hits", ratio(F.col("hits"), F.lit(p)).alias("recall"), (F.col("hits") / F.col("k")).alias("precision"), ratio(F.col("hits") / F.col("k"), F.lit(p / n)).alias("lift"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n): equal bins, the last one closed; values outside are left out."""
    width = (high - low) / bins or 1.0
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("bigint")
    return df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def decimated(df: DataFrame, order: Sequence[Column], points: int) -> DataFrame:
    """At most ``points`` rows, evenly spaced along ``order``, both ends kept."""
    r = ordering.with_group_size(ordering.row_numbers(df, order, "__rn"), [], "__n")
    i, last = F.col("__rn") - 1, F.greatest(F.col("__n") - 1, F.lit(1))
    k = F.round(i * (points - 1) / last)
    return r.where(F.round(k * last / (points - 1)).cast("bigint") == i).drop("__rn", "__n")


def curves(table: DataFrame, points: int = 220) -> DataFrame:
    """(score, fpr, tpr, precision): the ROC and PR curves, decimated."""
    p, n = totals(table)
    rows = decimated(table, [-F.col("score")], points)
    return rows.select("score", (F.col("fp") / max(1, n)).alias("fpr"), (F.col("tp") / max(1, p)).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def finite_scores(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """(detector, n, n_bad, usable): detectors with a null, NaN or infinite score are not ranked."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(bad(c)).alias(f"b{i}") for i, c in enumerate(scores)])
    rows = [F.struct(F.lit(c).alias("detector"), F.col(f"b{i}").alias("n_bad")) for i, c in enumerate(scores)]
    return sums.select("n", F.inline(F.array(*rows))).withColumn("usable", F.col("n_bad") == 0)


def regression(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """n, mae, rmse, r2, mape (with its coverage), bias, residual_std, baseline_mae."""
    Y, e = F.col(y), F.col(y) - F.col(p)
    big = F.abs(Y) > 1e-6
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e * e).alias("_mse"), F.var_pop(Y).alias("_var"), F.avg(F.when(big, F.abs(e / Y))).alias("mape"),
        F.avg(big.cast("double")).alias("mape_coverage"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("residual_std"))
    return out.withColumn("r2", F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var"))).drop("_mse", "_var")


def intervals(df: DataFrame, alpha: float, y: str = "y", low: str = "lo", high: str = "hi") -> DataFrame:
    """n, coverage, gap to 1 - alpha, mean_width, pinball losses, crossings, verdict (within 0.05)."""
    Y, lo, hi = F.col(y), F.col(low), F.col(high)
    pin = lambda q, t: F.avg(F.greatest(t * (Y - q), (t - 1) * (Y - q)))
    out = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(((Y >= lo) & (Y <= hi)).cast("double")).alias("coverage"), F.avg(hi - lo).alias("mean_width"),
        pin(lo, alpha / 2).alias("pinball_low"), pin(hi, 1 - alpha / 2).alias("pinball_high"), F.count_if(lo > hi).alias("n_crossed"))
    gap = F.col("coverage") - (1 - alpha)
    return out.withColumns({"gap": gap, "verdict": F.when(F.abs(gap) <= 0.05, "calibrated").when(gap < 0, "too narrow").otherwise("too wide")})


def conformal_adjustment(calibration_rows: DataFrame, alpha: float, y: str = "y", low: str = "lo", high: str = "hi", least: int = 20) -> float:
    """What to widen both ends by: the ceil(level * (n - 1))-th smallest of max(lo - y, y - hi)."""
    e = calibration_rows.select(F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high)).alias("e"))
    n = e.count()
    if n < least:
        raise ValueError(f"{n} calibration rows; at least {least} are needed")
    level = min(1.0, (1 - alpha) * (1 + 1 / n))
    at = -int(-(level * (n - 1)) // 1)
    cum = ordering.distinct_counts(e, "e")
    return cum.where(F.col("upto") >= at + 1).agg(F.min("e")).first()[0]


def conformal(df: DataFrame, adjustment: float, low: str = "lo", high: str = "hi") -> DataFrame:
    """``df`` with both ends moved out by the adjustment, and put in order if they cross."""
    lo, hi = F.col(low) - adjustment, F.col(high) + adjustment
    return df.withColumns({low: F.least(lo, hi), high: F.greatest(lo, hi)})
