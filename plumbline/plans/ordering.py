"""Exact global order statistics without a single-task sort.

``Window.orderBy`` without a partition key moves every row to one task, and a key that holds a
third of the table does nearly the same.  The functions here range-partition the rows by
(group, order, tie), which splits hot values and orders null, NaN and the infinities as Spark
does; each row's partition number is materialised once, so that totals and rows see the same;
the totals of the partitions are cumulated, and added to what is cumulated inside each.  There
is one way for every size; the number of partitions is a parameter that follows the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import durable

#: Columns of this prefix are the module's own.
PREFIX = "__ord_"


def _check(df: DataFrame) -> None:
    if clash := [c for c in df.columns if c.startswith(PREFIX)]:
        raise ValueError(f"columns {clash} have the reserved prefix {PREFIX}")


def _parts(df: DataFrame, partitions: int | None) -> int:
    return partitions or 2 * df.sparkSession.sparkContext.defaultParallelism


def cumulate(
    df: DataFrame, order: Sequence[Column], measures: Mapping[str, Column], group: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Adds inclusive running sums of ``measures`` along ``order`` in each group.

    ``order`` should be unique inside a group, else the rows of a tie come in any order.  Sums
    of doubles depend on the order of addition in their last bits.
    """
    _check(df)
    group = list(group)
    keys = [f"{PREFIX}k{i}" for i in range(len(order))]
    own = {m: f"{PREFIX}m{i}" for i, m in enumerate(measures)}
    work = df.select(
        *df.columns, *[c.alias(k) for c, k in zip(order, keys)], *[c.alias(own[m]) for m, c in measures.items()])
    part = f"{PREFIX}part"
    work = durable(work.repartitionByRange(_parts(df, partitions), *group, *keys).withColumn(part, F.spark_partition_id()))
    inside = Window.partitionBy(part, *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = work.select("*", *[F.sum(o).over(inside).alias(f"{o}l") for o in own.values()])
    totals = work.groupBy(part, *group).agg(*[F.sum(o).alias(f"{o}t") for o in own.values()])
    # One row for each partition that a group reaches.
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *group, *[F.sum(f"{o}t").over(before).alias(f"{o}b") for o in own.values()])
    a, b = local.alias("a"), offsets.alias("b")
    on = F.col(f"a.{part}") == F.col(f"b.{part}")
    for g in group:
        on = on & F.col(f"a.`{g}`").eqNullSafe(F.col(f"b.`{g}`"))
    zero = F.lit(0)
    return a.join(b, on).select(
        *[F.col(f"a.`{c}`") for c in df.columns],
        *[(F.col(f"a.{o}l") + F.coalesce(F.col(f"b.{o}b"), zero)).alias(m) for m, o in own.items()])


def row_numbers(
    df: DataFrame, order: Sequence[Column], out: str = "rn", group: Sequence[str] = (), partitions: int | None = None,
) -> DataFrame:
    """Exact 1-based position of every row in its group."""
    return cumulate(df, order, {out: F.lit(1).cast("bigint")}, group, partitions)


def with_group_size(df: DataFrame, group: Sequence[str], out: str = "n") -> DataFrame:
    """Attaches the size of each row's group, or of the table."""
    if not group:
        return df.withColumn(out, F.lit(df.count()).cast("bigint"))
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias(out)).alias("s")
    on = None
    for g in group:
        same = F.col(f"d.`{g}`").eqNullSafe(F.col(f"s.`{g}`"))
        on = same if on is None else on & same
    return df.alias("d").join(sizes, on).select(*[F.col(f"d.`{c}`") for c in df.columns], F.col(f"s.`{out}`"))


def distinct_counts(df: DataFrame, value: str, group: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """(group, value, ties, upto): the distinct values with their count and the running count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("ties"))
    return cumulate(counts, [F.col(value)], {"upto": F.col("ties")}, group, partitions)


def average_ranks(df: DataFrame, value: str, group: Sequence[str] = (), out: str = "rank", partitions: int | None = None) -> DataFrame:
    """Distinct values per group with their tie-averaged rank, and count."""
    cum = distinct_counts(df, value, group, partitions)
    return cum.withColumn(out, F.col("upto") - (F.col("ties") - 1) / 2.0).drop("upto")


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = (), partitions: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per (group, prob) -> ``quantile``.

    Nulls and NaN are left out; a probability asked for twice comes once.
    """
    group = list(group)
    probs = sorted({float(p) for p in probs})
    v = F.col("__v")
    clean = df.select(*group, F.col(value).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    cum = distinct_counts(clean, "__v", group, partitions)
    sizes = cum.groupBy(*group).agg(F.max("upto").alias("n")).alias("s")
    c = cum.alias("c")
    if group:
        on = None
        for g in group:
            same = F.col(f"c.`{g}`").eqNullSafe(F.col(f"s.`{g}`"))
            on = same if on is None else on & same
        both = c.join(sizes, on).select(*[F.col(f"c.`{g}`") for g in group], "c.__v", "c.ties", "c.upto", "s.n")
    else:
        both = cum.withColumn("n", F.lit(sizes.first()["n"]).cast("bigint"))
    return picked_quantiles(both, probs, group)


def picked_quantiles(counted: DataFrame, probs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """(group, prob, quantile) from (group, __v, ties, upto, n): values with their running counts, at least those at the ranks asked for."""
    v = F.col("__v")
    marked = counted.select("*", F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob"))
    h = (F.col("n") - 1) * F.col("prob")
    first, last = F.col("upto") - F.col("ties"), F.col("upto") - 1
    holds = lambda i: (i >= first) & (i <= last)
    picked = marked.where(holds(F.floor(h)) | holds(F.ceil(h))).groupBy(*group, "prob").agg(
        F.max(h).alias("h"), F.max(F.when(holds(F.floor(h)), v)).alias("a"), F.max(F.when(holds(F.ceil(h)), v)).alias("b"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))
    return picked.select(*group, "prob", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(value_at).alias("quantile"))


def quantile_columns(
    df: DataFrame, value: str, named: Mapping[str, float], group: Sequence[str] = (), partitions: int | None = None,
) -> DataFrame:
    """``quantiles`` with one column per name and one row per group."""
    return in_columns(quantiles(df, value, list(named.values()), group, partitions), named, group)


def in_columns(long: DataFrame, named: Mapping[str, float], group: Sequence[str] = ()) -> DataFrame:
    """One row per group of ``quantiles``, a column for each name."""
    return long.groupBy(*group).agg(*[F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(n) for n, p in named.items()])


def quantile_list(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """A fixed, small number of quantiles on the driver (bin edges)."""
    found = {r["prob"]: r["quantile"] for r in quantiles(df, value, probs).collect()}
    return [found.get(float(p)) for p in probs]


def portable_hash(key: Column, seed: int = 42) -> Column:
    """60 bits of the MD5 of seed and key: an order that another SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 15), 16, 10).cast("bigint")
