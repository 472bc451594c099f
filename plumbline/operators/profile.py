"""Data profiles: one row per column, in a number of jobs that does not follow the columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans import ordering

MARKS = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def long_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, col, v): one row per numeric cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(*keep, F.inline(cells))


def long_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, v): one row per cell, as text."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in columns])))


def corrected_skew(v: Column) -> Column:
    n, g = F.count(v), F.skewness(v)
    return F.when(n > 2, g * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))


def corrected_kurtosis(v: Column) -> Column:
    n, k = F.count(v), F.kurtosis(v)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, moments, bias-corrected shape, quantiles, fences and outliers per column."""
    long = long_numeric(df, columns)
    v = F.col("v")
    base = long.groupBy("col").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), corrected_skew(v).alias("skew"), corrected_kurtosis(v).alias("kurtosis"), F.count_if(v == 0).alias("n_zero"),
        F.count_if(v < 0).alias("n_negative"), F.count_distinct(v).alias("n_unique"))
    out = base.join(ordering.quantile_columns(long, "v", MARKS, ["col"]), "col", "left")
    iqr = F.col("p75") - F.col("p25")
    out = out.withColumns({"iqr": iqr, "fence_low": F.col("p25") - 1.5 * iqr, "fence_high": F.col("p75") + 1.5 * iqr})
    fences = F.broadcast(out.select("col", "fence_low", "fence_high"))  # one row per column
    outliers = long.join(fences, "col").groupBy("col").agg(F.count_if((v < F.col("fence_low")) | (v > F.col("fence_high"))).alias("n_outliers"))
    return out.join(outliers, "col")


def clipped_histogram(df: DataFrame, columns: Sequence[str], bins: int = 28, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(col, bin, n): equal bins between two quantiles, the last closed; -1 is below, ``bins`` above."""
    long = long_numeric(df, columns).where("v is not null")
    q = ordering.quantile_columns(long, "v", {"lo": low, "hi": high}, ["col"])
    ends = long.groupBy("col").agg(F.min("v").alias("a"), F.max("v").alias("b")).join(q, "col")
    flat = F.col("hi") <= F.col("lo")
    ends = ends.select("col", F.when(flat, F.col("a")).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("b")).otherwise(F.col("hi")).alias("hi"))
    both = long.join(F.broadcast(ends), "col")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), bins).otherwise(
        F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0))
    return both.groupBy("col", at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, missing, distinct values, mode (ties: the smallest), and a high-cardinality flag per column."""
    counts = long_text(df, columns).groupBy("col", "v").agg(F.count(F.lit(1)).alias("c"))
    real = F.col("v").isNotNull()
    out = counts.groupBy("col").agg(
        F.sum(F.when(real, F.col("c")).otherwise(0)).alias("n"), F.sum(F.when(~real, F.col("c")).otherwise(0)).alias("n_missing"),
        F.count_if(real).alias("n_unique"), F.min(F.when(real, F.struct((-F.col("c")).alias("c"), "v")))["v"].alias("mode"))
    ratio = F.col("n_unique") / F.greatest("n", F.lit(1))
    return out.withColumns({"cardinality_ratio": ratio, "high_cardinality": (F.col("n_unique") > 50) & (ratio > 0.5)})


def top_values(df: DataFrame, columns: Sequence[str], k: int = 12) -> DataFrame:
    """(col, rank, v, n, share): the k most frequent values of each column."""
    counts = long_text(df, columns).where("v is not null").groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
    totals = F.broadcast(counts.groupBy("col").agg(F.sum("n").alias("total")))
    rank = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "v"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k).join(totals, "col")
    return top.select("col", "rank", "v", "n", (F.col("n") / F.col("total")).alias("share"))


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of each pair of columns, over the rows where both have a value; one job."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.nanvl(f"r{i}", F.lit(0.0)), F.lit(0.0)).alias("r")) for i, (a, b) in enumerate(pairs)])))


def spearman(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """As ``pearson``, on tie-averaged ranks; ``key`` names the rows."""
    long = long_numeric(df, columns, [key])
    ranks = ordering.average_ranks(long, "v", ["col"])
    wide = long.join(ranks, ["col", "v"], "left").groupBy(key).pivot("col", list(columns)).agg(F.max("rank"))
    return pearson(wide, columns)


def missingness(df: DataFrame) -> DataFrame:
    """(col, n_missing, share) per column, and a row ``*`` for rows with any missing cell."""
    cs = df.columns
    null = lambda c: F.col(f"`{c}`").isNull()
    any_ = F.lit(False)
    for c in cs:
        any_ = any_ | null(c)
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(any_).alias("x"), *[F.count_if(null(c)).alias(f"m{i}") for i, c in enumerate(cs)])
    rows = [F.struct(F.lit("*").alias("col"), F.col("x").alias("n_missing"))] + [F.struct(F.lit(c).alias("col"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(cs)]
    return sums.select("n", F.inline(F.array(*rows))).select("col", "n_missing", (F.col("n_missing") / F.greatest("n", F.lit(1))).alias("share"))


def scorecard(df: DataFrame, key: Sequence[str], rules: Mapping[str, str], order: str, text: Sequence[str]) -> DataFrame:
    """(dimension, score): completeness, uniqueness, validity, consistency, timeliness, cardinality; and the mean with a grade.

    ``rules`` are expression strings; null counts as a violation.  A missing key column is an error.
    """
    cs = df.columns
    if missing := [k for k in [*key, order] if k not in cs]:
        raise ValueError(f"no columns {missing}")
    distinct = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") - 1).alias("dup"))
    one = df.agg(
        F.count(F.lit(1)).alias("n"), sum((F.count_if(F.col(c).isNull()) for c in cs), F.lit(0)).alias("nulls"),
        sum((F.count_if(~F.coalesce(F.expr(r), F.lit(False))) for r in rules.values()), F.lit(0)).alias("bad"),
        F.count_if(F.col(order).isNull()).alias("late"),
        *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))).alias(f"d{i}") for i, c in enumerate(cs)])
    both = one.withColumn("dup", F.lit(distinct.first()["dup"] or 0))  # one number
    n = F.greatest("n", F.lit(1))
    constant = sum(((F.col(f"d{i}") <= 1).cast("int") for i in range(len(cs))), F.lit(0))
    ids = sum(((F.col(f"d{cs.index(c)}") > 0.95 * n).cast("int") for c in text), F.lit(0))
    scores = {
        "completeness": 1 - F.col("nulls") / (n * len(cs)), "uniqueness": 1 - F.col("dup") / n, "validity": 1 - F.col("bad") / (n * max(1, len(rules))),
        "consistency": 1 - constant / len(cs), "timeliness": 1 - F.col("late") / n, "cardinality": 1 - ids / max(1, len(text))}
    mean = sum((s for s in scores.values()), F.lit(0.0)) / len(scores)
    rows = [F.struct(F.lit(k).alias("dimension"), s.cast("double").alias("score")) for k, s in scores.items()] + [F.struct(F.lit("overall").alias("dimension"), mean.cast("double").alias("score"))]
    out = both.select(F.inline(F.array(*rows)))
    grade = F.when(F.col("score") >= 0.95, "A").when(F.col("score") >= 0.85, "B").when(F.col("score") >= 0.7, "C").otherwise("D")
    return out.withColumn("grade", grade)


def separability(df: DataFrame, columns: Sequence[str], label: str, least: int = 5) -> DataFrame:
    """(col, n0, n1, d): Cohen's d with pooled variance, for columns with enough rows of both classes."""
    long = long_numeric(df, columns, [label]).where("v is not null")
    pick = lambda k, f: f(F.when(F.col(label) == k, F.col("v")))
    a = long.groupBy("col").agg(*[pick(k, f).alias(f"{name}{k}") for k in (0, 1) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2)
    a = a.where((F.col("n0") >= least) & (F.col("n1") >= least))
    return a.select("col", "n0", "n1", F.when(pooled > 0, (F.col("m1") - F.col("m0")) / F.sqrt(pooled)).otherwise(0.0).alias("d"))
