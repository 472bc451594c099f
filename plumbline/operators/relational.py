"""Relational building blocks over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b where b > 0, else null."""
    return F.when(b > 0, a / b)


def to_number(text: Column) -> Column:
    """A double, or null where the text is none."""
    return text.try_cast("double")


def mapped(value: Column, table: Mapping, default) -> Column:
    """The value's entry in a short fixed table, else ``default``."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == F.lit(k), F.lit(v)).otherwise(out)
    return out


def binned(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins between fixed edges; outside of them null."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges, edges[1:], labels):
        out = F.when((value > low) & (value <= high), F.lit(label)).otherwise(out)
    return out


def membership_count(columns: Sequence[Column], values: Sequence) -> Column:
    """How many of a row's columns have one of ``values``."""
    return sum((F.coalesce(c.isin(list(values)), F.lit(False)).cast("bigint") for c in columns), F.lit(0).cast("bigint"))


def lookup(df: DataFrame, dimension: DataFrame, on: Mapping[str, str], take: Mapping[str, str], default=None) -> DataFrame:
    """Left equi-lookup: ``on`` maps columns of ``df`` to key columns, ``take`` new names to columns.

    The dimension has one row per key.  Misses get ``default``.
    """
    d = dimension.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on.values())], *[F.col(c).alias(n) for n, c in take.items()])
    condition = None
    for i, c in enumerate(on):
        same = F.col(c) == F.col(f"__k{i}")
        condition = same if condition is None else condition & same
    out = df.join(d, condition, "left").drop(*[f"__k{i}" for i in range(len(on))])
    return out.fillna({n: default for n in take}) if default is not None else out


def first_failure(rules: Mapping[str, Column]) -> Column:
    """The name of the first rule that does not hold; null counts as failing; null if all hold."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules.items()):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def exclusion_ledger(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(step, rule, n_removed, pct_of_raw): every row is charged to the first rule it fails.

    One pass; rules that remove nothing have a row too.  Step 0 is what is kept.
    """
    names = list(rules)
    sums = df.select(first_failure(rules).alias("r")).agg(
        F.count(F.lit(1)).alias("raw"), F.sum(F.col("r").isNull().cast("bigint")).alias("k"),
        *[F.sum((F.col("r") == n).cast("bigint")).alias(f"n{i}") for i, n in enumerate(names)])
    rows = [F.struct(F.lit(0).alias("step"), F.lit("kept").alias("rule"), F.coalesce("k", F.lit(0)).alias("n_rows"))]
    rows += [F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("rule"), F.coalesce(f"n{i}", F.lit(0)).alias("n_rows")) for i, n in enumerate(names)]
    return sums.select("raw", F.inline(F.array(*rows))).select(
        "step", "rule", "n_rows", F.round(100.0 * F.col("n_rows") / F.greatest(F.col("raw"), F.lit(1)), 4).alias("pct_of_raw"))


def with_fallback(df: DataFrame, train: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds the training rows' mean of ``value`` per key, or their overall mean for keys not seen."""
    per_key = train.groupBy(*keys).agg(F.avg(value).alias("__own"))
    overall = train.agg(F.avg(value)).first()[0]
    return df.join(per_key, list(keys), "left").withColumn(out, F.coalesce("__own", F.lit(overall))).drop("__own")


def stacked(df: DataFrame, columns: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """The same aggregates over several single-column groupings: (dimension, value, ...), one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select("*", F.inline(pairs)).groupBy("dimension", "value").agg(*aggregates)


def completed(df: DataFrame, grid: Mapping[str, Sequence], fill: Mapping) -> DataFrame:
    """``df`` on the whole grid of fixed domains; missing cells get ``fill``."""
    frame = df.sparkSession.range(1).select()
    for name, values in grid.items():
        frame = frame.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return frame.join(df, list(grid), "left").fillna(dict(fill))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(n_rows, n_duplicates): rows beyond the first of each key; all columns if none is given."""
    counts = df.groupBy(*(key or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates"))
