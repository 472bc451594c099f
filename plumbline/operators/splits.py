"""Splits and folds as columns of the table, and checks that nothing leaks between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans import ordering


def stratified(df: DataFrame, key: str, label: str, share: float, seed: int = 42, out: str = "part") -> DataFrame:
    """'test' for floor(n * share) rows of each class, in order of a seeded hash; else 'train'."""
    h = ordering.portable_hash(F.col(key), seed)
    r = ordering.with_group_size(ordering.row_numbers(df, [h, F.col(key)], "__rn", [label]), [label], "__n")
    return r.withColumn(out, F.when(F.col("__rn") <= F.floor(F.col("__n") * share), "test").otherwise("train")).drop("__rn", "__n")


def folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Stratified folds 0 to k - 1."""
    h = ordering.portable_hash(F.col(key), seed)
    r = ordering.row_numbers(df, [h, F.col(key)], "__rn", [label])
    return r.withColumn(out, (F.col("__rn") - 1) % k).drop("__rn")


def by_group(df: DataFrame, group: str, share: float, seed: int = 42, out: str = "part") -> DataFrame:
    """'test' for max(1, floor(G * share)) whole groups."""
    groups = df.select(group).distinct()
    n = groups.count()
    r = ordering.row_numbers(groups, [ordering.portable_hash(F.col(group), seed), F.col(group)], "__rn")
    marks = r.select(F.col(group).alias("__g"), F.when(F.col("__rn") <= max(1, int(n * share)), "test").otherwise("train").alias(out))
    return df.join(marks, df[group].eqNullSafe(marks["__g"])).drop("__g")


def chronological(df: DataFrame, order: Sequence[Column], share: float, out: str = "part") -> DataFrame:
    """'train' for the first int(n * (1 - share)) rows along ``order``; else 'test'."""
    r = ordering.with_group_size(ordering.row_numbers(df, order, "__rn"), [], "__n")
    return r.withColumn(out, F.when(F.col("__rn") <= F.floor(F.col("__n") * (1 - share)), "train").otherwise("test")).drop("__rn", "__n")


def purged_folds(df: DataFrame, order: Sequence[Column], k: int, window: int, embargo: int) -> DataFrame:
    """(row, fold, part): expanding folds; ``window`` rows before and ``embargo`` rows after a fold's start are left out."""
    n = df.count()
    size = n // (k + 1)
    if size <= window + embargo:
        raise ValueError(f"folds of {size} rows are too short for window {window} and embargo {embargo}")
    r = ordering.row_numbers(df, order, "__rn").withColumn("__i", F.col("__rn") - 1)
    frame = r.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(1, k + 1)])))
    start = F.col("fold") * size
    end = F.when(F.col("fold") == k, F.lit(n)).otherwise(start + size)
    part = F.when(F.col("__i") < start - window, "train").when((F.col("__i") >= start + embargo) & (F.col("__i") < end), "validation")
    return frame.withColumn("part", part).where("part is not null").drop("__rn", "__i")


def describe(df: DataFrame, part: str = "part") -> DataFrame:
    counts = df.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.withColumn("share", F.col("n") / total)


def shared_keys(df: DataFrame, key: str, part: str = "part") -> DataFrame:
    """Keys with rows in more than one part: empty if the split is disjoint by key."""
    return df.groupBy(key).agg(F.count_distinct(part).alias("parts")).where("parts > 1").select(key)


def require_disjoint(df: DataFrame, key: str, part: str = "part") -> None:
    if found := [r[0] for r in shared_keys(df, key, part).limit(5).collect()]:
        raise ValueError(f"{key} in more than one part: {found}")


def is_chronological(df: DataFrame, ts: str, part: str = "part") -> bool:
    """No training row is later than a test row."""
    r = df.agg(F.max(F.when(F.col(part) == "train", F.col(ts))), F.min(F.when(F.col(part) == "test", F.col(ts)))).first()
    return r[0] is None or r[1] is None or r[0] <= r[1]


def require_absent(columns: Sequence[str], forbidden: Sequence[str]) -> None:
    if found := sorted(set(columns) & set(forbidden)):
        raise ValueError(f"forbidden features: {found}")
