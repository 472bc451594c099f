"""Feature transformers that learn from training rows only.

What a transformer learns is a table (``learned``), one row per category or column, joined to
the rows that are transformed; it can be written and read like any table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.profile import long_numeric
from plumbline.plans import ordering


@dataclass(frozen=True)
class Fitted:
    """A transformer's kind and columns, and what it has learned."""

    kind: str
    columns: tuple[str, ...]
    learned: DataFrame

    def save(self, path: str) -> None:
        spark = self.learned.sparkSession
        self.learned.write.parquet(f"{path}/learned")
        spark.createDataFrame([(self.kind, list(self.columns))], "kind string, columns array<string>").write.parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        about = spark.read.parquet(f"{path}/about").first()
        return Fitted(about["kind"], tuple(about["columns"]), spark.read.parquet(f"{path}/learned"))

    def transform(self, df: DataFrame) -> DataFrame:
        return APPLY[self.kind](self, df)


def fit_frequency(train: DataFrame, column: str, normalise: bool = True) -> Fitted:
    """Category -> its count, or share of the training rows."""
    n = train.count()
    c = F.count(F.lit(1)).cast("double")
    return Fitted("frequency", (column,), train.groupBy(F.col(column).alias("__k")).agg((c / F.lit(float(max(1, n))) if normalise else c).alias("__v")))


def _frequency(f: Fitted, df: DataFrame) -> DataFrame:
    c = f.columns[0]
    out = df.join(f.learned, df[c].eqNullSafe(f.learned["__k"]), "left").drop("__k")
    return out.withColumn(f"{c}_freq", F.coalesce("__v", F.lit(0.0))).drop("__v")


def fit_rare(train: DataFrame, column: str, least: float) -> Fitted:
    """The categories with at least this share of the rows that have one."""
    some = train.where(F.col(column).isNotNull())
    n = some.count()
    return Fitted("rare", (column,), some.groupBy(F.col(column).alias("__k")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least * n).select("__k"))


def _rare(f: Fitted, df: DataFrame) -> DataFrame:
    c = f.columns[0]
    return df.join(f.learned, df[c] == f.learned["__k"], "left").withColumn(c, F.coalesce("__k", F.lit("__rare__"))).drop("__k")


def fit_columns(train: DataFrame, kind: str, columns: Sequence[str]) -> Fitted:
    """winsor, median, standard, robust or log_standard: a few numbers per column, all columns at once."""
    long = long_numeric(train, columns)
    if kind in ("standard", "log_standard"):
        v = F.log1p("v") if kind == "log_standard" else F.col("v")
        table = long.groupBy("col").agg(F.avg(v).alias("a"), F.stddev_pop(v).alias("b"))
    else:
        marks = {"winsor": {"a": 0.001, "b": 0.999}, "median": {"a": 0.5, "b": 0.5}, "robust": {"a": 0.5, "lo": 0.05, "hi": 0.95}}[kind]
        table = ordering.quantile_columns(long, "v", marks, ["col"])
        if kind == "robust":
            table = table.select("col", "a", (F.col("hi") - F.col("lo")).alias("b"))
    return Fitted(kind, tuple(columns), table)


def _columns(f: Fitted, df: DataFrame) -> DataFrame:
    found: Mapping = {r["col"]: (r["a"], r["b"]) for r in f.learned.collect()}  # one row per column
    out = {}
    for c in f.columns:
        a, b = found[c]
        x = F.col(c).cast("double")
        if f.kind == "winsor":
            out[c] = F.when(x < a, a).when(x > b, b).otherwise(x)
        elif f.kind == "median":
            out[c] = F.coalesce(F.nanvl(x, F.lit(None)), F.lit(a))
        else:
            y = F.log1p(x) if f.kind == "log_standard" else x
            out[c] = (y - a) / (b or 1.0)
    return df.withColumns(out)


def fit_mode(train: DataFrame, column: str) -> Fitted:
    """The most frequent value; ties go to the smallest."""
    counts = train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__k")).agg(F.count(F.lit(1)).alias("c"))
    return Fitted("mode", (column,), counts.agg(F.min(F.struct((-F.col("c")).alias("c"), "__k"))["__k"].alias("__k")))


def _mode(f: Fitted, df: DataFrame) -> DataFrame:
    return df.fillna({f.columns[0]: f.learned.first()["__k"]})


def fit_one_hot(train: DataFrame, column: str, least: float = 0.0) -> Fitted:
    f = fit_rare(train, column, least)
    return Fitted("one_hot", (column,), ordering.row_numbers(f.learned, [F.col("__k")], "__i"))


def _one_hot(f: Fitted, df: DataFrame) -> DataFrame:
    """The category's place (from 1) in the learned order: a sparse one-hot; 0 for unknown ones."""
    c = f.columns[0]
    out = df.join(f.learned, df[c] == f.learned["__k"], "left").drop("__k")
    return out.withColumn(f"{c}_index", F.coalesce("__i", F.lit(0).cast("bigint"))).drop("__i")


APPLY = {
    "frequency": _frequency, "rare": _rare, "mode": _mode, "one_hot": _one_hot,
    "winsor": _columns, "median": _columns, "standard": _columns, "robust": _columns, "log_standard": _columns,
}
