"""Decisions from scores: economics, budgets, and fairness between groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import evaluation
from plumbline.operators.evaluation import confusion, gain, ratio
from plumbline.plans import ordering
from plumbline.session import durable


@dataclass(frozen=True)
class Economics:
    """Of a campaign: value of a saved customer, cost of a contact, and the share that accepts."""

    value: float = 500.0
    contact_cost: float = 40.0
    acceptance: float = 0.3

    @property
    def threshold(self) -> float:
        """Where a contact breaks even: cost_fp / (cost_fp + cost_fn)."""
        return self.contact_cost / (self.contact_cost + self.value * self.acceptance)


def expected_value(df: DataFrame, e: Economics, score: str = "score") -> DataFrame:
    """Adds expected_value, break_even and action."""
    value = F.col(score) * e.acceptance * e.value - e.contact_cost
    return df.withColumns({
        "expected_value": value, "break_even": F.lit(e.contact_cost / (e.acceptance * e.value)),
        "action": F.when(value > 0, "contact").otherwise("leave")})


def campaign(df: DataFrame, tie: str, e: Economics, shares: Sequence[float], label: str = "label", score: str = "score") -> DataFrame:
    """(share, k, hits, recall, precision, cost, saved, net, roi) along the shares contacted."""
    g = gain(df, tie, shares, label, score).drop("lift")
    cost, saved = F.col("k") * e.contact_cost, F.col("hits") * e.acceptance * e.value
    return g.withColumns({"cost": cost, "saved": saved, "net": saved - cost, "roi": (saved - cost) / cost})


def bands(score: Column, low: float = 0.33, high: float = 0.66) -> Column:
    return F.when(score >= high, "high").when(score >= low, "medium").otherwise("low")


def group_rates(df: DataFrame, by: str, threshold: float, least: int = 1, label: str = "label", score: str = "score") -> DataFrame:
    """Rates per group of at least ``least`` rows: base and selection rate, tpr, fpr, tnr, fnr, precision, accuracy."""
    c = confusion(df, threshold, label, score, [by])
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return c.withColumns({
        "n": n, "base_rate": ratio(tp + fn, n), "selection_rate": ratio(tp + fp, n), "tpr": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn),
        "tnr": ratio(tn, fp + tn), "fnr": ratio(fn, tp + fn), "precision": ratio(tp, tp + fp), "accuracy": ratio(tp + tn, n)}).where(F.col("n") >= least)


def group_report(rates: DataFrame) -> DataFrame:
    """One row: the most selected group's rate as reference, disparate impact, and differences of rates."""
    span = lambda c: F.max(c) - F.min(c)
    least = F.min("selection_rate") / F.max("selection_rate")
    return rates.agg(
        F.count(F.lit(1)).alias("n_groups"), F.max("selection_rate").alias("reference_rate"), least.alias("disparate_impact"), (least >= 0.8).alias("four_fifths"),
        span("selection_rate").alias("parity_difference"), span("tpr").alias("opportunity_difference"),
        F.greatest(span("tpr"), span("fpr")).alias("odds_difference"), span("base_rate").alias("base_rate_difference"))


def equalised(df: DataFrame, by: str, threshold: float, label: str = "label", score: str = "score", points: int = 81, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(by, threshold, tpr, gap): per group, the first threshold whose tpr is closest to the overall one."""
    marks = [low + (high - low) * i / (points - 1) for i in range(points)]
    grid = F.array(*[F.lit(m) for m in marks])
    overall = confusion(df, threshold, label, score).select(ratio(F.col("tp"), F.col("tp") + F.col("fn"))).first()[0]
    counts = df.where(F.col(label) == 1).groupBy(by, F.size(F.filter(grid, lambda m: m <= F.col(score))).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy(by).agg(F.sum("c").alias("p"))
    # points + 1 rows per group from here on.
    frame = total.select(by, "p", F.posexplode(grid).alias("i", "threshold"))
    reached = counts.select(by, "c", F.explode(F.when(F.col("k") > 0, F.sequence(F.lit(0), F.greatest(F.col("k") - 1, F.lit(0))))).alias("i")).groupBy(by, "i").agg(F.sum("c").alias("tp"))
    at = frame.join(reached, [by, "i"], "left").fillna({"tp": 0}).withColumn("tpr", F.col("tp") / F.col("p"))
    best = at.groupBy(by).agg(F.min(F.struct(F.abs(F.col("tpr") - overall).alias("gap"), "i", "threshold", "tpr")).alias("b"))
    return best.select(by, F.col("b.threshold").alias("threshold"), F.col("b.tpr").alias("tpr"), F.col("b.gap").alias("gap"))


#: Score groups that isotonic regression is fitted on.
GROUPS = 2000


class Isotonic:
    """Isotonic calibration of a score: ``fit(df)`` gives a model with ``transform(df)``.

    Scores are first put into GROUPS groups of equal numbers of rows, by exact quantiles, and the
    regression sees each group's mean score, mean label and weight; with no more distinct scores
    than GROUPS each is its own group, and the fit is the exact one.  So what it pools is bounded.
    """

    def __init__(self, score: str, label: str, out: str, groups: int = GROUPS) -> None:
        self.score, self.label, self.out, self.groups = score, label, out, groups

    def fit(self, df: DataFrame):
        from pyspark.ml.regression import IsotonicRegression

        counts = df.where(F.col(self.score).isNotNull() & F.col(self.label).isNotNull()).groupBy(F.col(self.score).alias(self.score)).agg(
            F.count(F.lit(1)).alias("w"), F.sum(self.label).alias("y"))
        counts = durable(counts)
        if counts.count() > self.groups:
            upto = ordering.cumulate(counts, [F.col(self.score)], {"upto": F.col("w")})
            total = upto.agg(F.max("upto")).first()[0]
            group = F.floor((F.col("upto") - 1) * self.groups / F.lit(total))
            counts = durable(upto.groupBy(group.alias("g")).agg((F.sum(F.col(self.score) * F.col("w")) / F.sum("w")).alias(self.score), F.sum("y").alias("y"), F.sum("w").alias("w")))
        rows = counts.select(F.col(self.score).cast("double").alias(self.score), (F.col("y") / F.col("w")).alias(self.label), F.col("w").cast("double").alias("w"))
        return IsotonicRegression(featuresCol=self.score, labelCol=self.label, weightCol="w", predictionCol=self.out).fit(rows)


def calibration_comparison(df: DataFrame, columns: dict[str, str], label: str = "label", bins: int = 10) -> DataFrame:
    """(stage, n, mean_predicted, observed, brier, log_loss, average_precision, ece) for each column of scores, on the same rows."""
    out = None
    for stage, c in columns.items():
        rows = durable(df.select(F.col(label).alias("label"), F.col(c).alias("score")))
        ap = evaluation.ranking_metrics(evaluation.score_table(rows)).first()["average_precision"]
        ece = evaluation.calibration_error(evaluation.calibration(rows, bins)).first()["ece"]
        loss = evaluation.probability_losses(rows).first()
        means = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_predicted"), F.avg("label").alias("observed"))
        one = means.select(F.lit(stage).alias("stage"), "*", *[F.lit(v).alias(k) for k, v in (("brier", loss["brier"]), ("log_loss", loss["log_loss"]), ("average_precision", ap), ("ece", ece))])
        out = one if out is None else out.unionByName(one)
    return out
