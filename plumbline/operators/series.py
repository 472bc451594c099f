"""Hourly series on a gap-free grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly(df: DataFrame, ts: str, measures: Mapping[str, Column], key: Sequence[str] = ()) -> DataFrame:
    """Measures per (key, hour), with a row for every hour between a key's first and last.

    Missing hours have null measures; nothing is imputed.
    """
    key = list(key)
    rows = df.groupBy(*key, F.date_trunc("hour", ts).alias("hour")).agg(*[c.alias(n) for n, c in measures.items()])
    rows = rows.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    spans = rows.groupBy(*key).agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    grid = spans.select(*key, F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour"))
    if not key:
        return grid.join(rows, "hour", "left")
    on = F.col("g.hour") == F.col("r.hour")
    for k in key:
        on = on & F.col(f"g.{k}").eqNullSafe(F.col(f"r.{k}"))
    return grid.alias("g").join(rows.alias("r"), on, "left").select(*[F.col(f"g.{k}") for k in key], "g.hour", *[F.col(f"r.{m}") for m in measures])


def lags(grid: DataFrame, value: str, steps: Sequence[int], key: Sequence[str]) -> DataFrame:
    """Adds ``lag_k`` for each step; ``grid`` is gap-free, one key is one window."""
    w = Window.partitionBy(*key).orderBy("hour")
    return grid.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in steps})


def trailing(grid: DataFrame, value: str, windows: Sequence[int], key: Sequence[str]) -> DataFrame:
    """Adds mean, sample standard deviation and maximum of the rows before, without the current.

    Null with fewer than max(2, w // 4) values in the window of w rows.
    """
    out = {}
    for w in windows:
        over = Window.partitionBy(*key).orderBy("hour").rowsBetween(-w, -1)
        enough = F.count(value).over(over) >= max(2, w // 4)
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max)):
            out[f"roll_{name}_{w}"] = F.when(enough, f(value).over(over))
    return grid.withColumns(out)


def interpolated(grid: DataFrame, value: str, key: Sequence[str], out: str) -> DataFrame:
    """Linear between the neighbours that have a value; the nearest one beyond the ends."""
    order = Window.partitionBy(*key).orderBy("hour")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = F.unix_timestamp(F.col("hour").cast("timestamp")).cast("double")
    x = F.when(F.col(value).isNotNull(), at)
    x0, x1 = F.last(x, True).over(before), F.first(x, True).over(after)
    y0, y1 = F.last(value, True).over(before), F.first(value, True).over(after)
    line = F.when(x1 > x0, y0 + (y1 - y0) * (at - x0) / (x1 - x0)).otherwise(y0)
    return grid.withColumn(out, F.coalesce(F.col(value).cast("double"), line, y0, y1))


def autocorrelation(df: DataFrame, order: str, value: str, lags_: int) -> DataFrame:
    """(lag, acf, band) of one gap-free series whose ``order`` is consecutive whole numbers."""
    n, mean = df.agg(F.count(value), F.avg(value)).first()
    x = df.select(F.col(order).alias("i"), (F.col(value) - F.lit(mean)).alias("x"))
    ahead = x.select("x", F.posexplode(F.sequence(F.col("i"), F.col("i") + lags_)).alias("lag", "j"))
    both = ahead.join(x.select(F.col("i").alias("j"), F.col("x").alias("y")), "j")
    sums = both.groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    base = x.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
    return sums.select(F.col("lag").cast("bigint").alias("lag"), (F.col("s") / F.lit(base)).alias("acf"), F.lit(1.96 / max(1, n) ** 0.5).alias("band"))


def partial_autocorrelation(acf: Sequence[float]) -> list[float]:
    """From autocorrelations 0, 1, ... (a short list), by the Durbin-Levinson recursion of Yule and Walker."""
    out, phi, error = [1.0], [], 1.0
    for k in range(1, len(acf)):
        a = (acf[k] - sum(p * acf[k - 1 - j] for j, p in enumerate(phi))) / error if error > 0 else 0.0
        phi = [p - a * q for p, q in zip(phi, reversed(phi))] + [a]
        error *= 1 - a * a
        out.append(a)
    return out


def decomposed(df: DataFrame, order: str, value: str, period: int) -> DataFrame:
    """Adds trend (centred mean over a period), seasonal (mean of what is left, by phase, centred) and residual.

    ``order`` is consecutive whole numbers; the trend is null where the window is not full.
    """
    half = period // 2
    i = F.col(order)
    weights = F.array(*[F.struct(F.lit(d).alias("d"), F.lit((0.5 if abs(d) == half and period % 2 == 0 else 1.0) / period).alias("w")) for d in range(-half, half + 1)])
    spread = df.select(i.alias("j"), F.col(value).alias("y"), F.inline(weights)).groupBy((F.col("j") + F.col("d")).alias(order)).agg(F.sum(F.col("y") * F.col("w")).alias("trend"), F.count(F.lit(1)).alias("c"))
    out = df.join(spread.where(F.col("c") == 2 * half + 1).drop("c"), order, "left")
    phase = out.groupBy((i % period).alias("phase")).agg(F.avg(F.col(value) - F.col("trend")).alias("s"))
    mean = phase.agg(F.avg("s")).first()[0] or 0.0
    out = out.withColumn("phase", i % period).join(F.broadcast(phase), "phase").drop("phase")  # one row per phase
    return out.withColumn("seasonal", F.col("s") - mean).drop("s").withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))
