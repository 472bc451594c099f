"""Customer segments: RFM tables and scores, clusterings and how good they are."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans import ordering


def rfm(lines: DataFrame) -> DataFrame:
    """Recency (days to the day after the last order), frequency, monetary and more, per customer.

    ``lines``: customer, order, item, day, amount, quantity.
    """
    last = lines.agg(F.max("day")).first()[0]
    out = lines.groupBy("customer").agg(
        F.max("day").alias("last"), F.min("day").alias("first"), F.count_distinct("order").alias("frequency"), F.sum("amount").alias("monetary"),
        F.count_distinct("item").alias("n_items"), F.sum("quantity").alias("quantity"))
    return out.select(
        "customer", (F.datediff(F.lit(last), "last") + 1).cast("bigint").alias("recency"), "frequency", "monetary", "n_items", "quantity",
        F.datediff("last", "first").cast("bigint").alias("tenure"), (F.col("monetary") / F.col("frequency")).alias("basket_value"))


def quintile(rank: Column, n: Column) -> Column:
    """1 to 5 by position: the smallest k with rank <= 1 + (n - 1) k / 5."""
    out = F.lit(5)
    for k in (4, 3, 2, 1):
        out = F.when(rank <= 1 + (n - 1) * k / 5, F.lit(k)).otherwise(out)
    return out


def rfm_scores(table: DataFrame) -> DataFrame:
    """Adds r, f, m (1 to 5, 5 is best), their total and the cell; ties in order of the customer."""
    out = ordering.with_group_size(table, [], "__n")
    for name, column, sign in (("r", "recency", -1), ("f", "frequency", 1), ("m", "monetary", 1)):
        out = ordering.row_numbers(out, [F.col(column) * sign, F.col("customer")], "__rn").withColumn(name, quintile(F.col("__rn"), F.col("__n"))).drop("__rn")
    return out.drop("__n").withColumns({"total": F.col("r") + F.col("f") + F.col("m"), "cell": F.concat("r", "f", "m")})


def vectors(df: DataFrame, columns: Sequence[str], scale: bool = True) -> DataFrame:
    """Adds ``features``, standardised by default."""
    out = VectorAssembler(inputCols=list(columns), outputCol="__raw").transform(df)
    if not scale:
        return out.withColumnRenamed("__raw", "features")
    return StandardScaler(withMean=True, inputCol="__raw", outputCol="features").fit(out).transform(out).drop("__raw")


def cluster_sums(df: DataFrame, x: str = "x", cluster: str = "cluster") -> DataFrame:
    """(cluster, n, sum, ss): size, vector sum and sum of squared norms, of array column ``x``."""
    long = df.select(cluster, F.posexplode(x).alias("i", "v"))
    by = long.groupBy(cluster, "i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n"))
    return by.groupBy(cluster).agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("sum"), F.sum("q").alias("ss"))


def silhouettes(df: DataFrame, x: str = "x", cluster: str = "cluster") -> DataFrame:
    """Adds ``silhouette`` by squared Euclidean distances, exactly, from each cluster's sums.

    The mean squared distance of a row to a cluster is |x|^2 - 2 x . S / n + Q / n.  The clusters are
    k rows, sent to the tasks, so that the plan does not grow with them; a row alone in its cluster has 0.
    """
    sums = cluster_sums(df, x, cluster).where(F.col(cluster).isNotNull()).collect()  # k rows
    if not sums:
        return df.withColumn("silhouette", F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast((
        {r[cluster]: i for i, r in enumerate(sums)}, np.array([r["n"] for r in sums], float), np.array([r["sum"] for r in sums], float), np.array([r["ss"] for r in sums], float)))

    @F.arrow_udf("double")
    def judged(points: pa.Array, labels: pa.Array) -> pa.Array:
        at, n, centres, squares = shared.value
        out = np.zeros(len(points))
        gone = np.zeros(len(points), bool)
        label = np.array([at.get(v, -1) for v in labels.to_pylist()], int)
        many = (label >= 0) & (n[label] > 1)
        # As by row: a point without components, or without another cluster, has none.
        known = many & np.array(points.is_valid()) & (len(n) > 1)
        gone[many & ~known] = True
        rows = np.flatnonzero(known)
        step = max(1, (1 << 20) // centres.size)
        for i in range(0, len(rows), step):
            own = rows[i : i + step]
            v = np.array(points.take(pa.array(own)).to_pylist(), float)
            total = (v * v).sum(axis=1)[:, None] * n - 2 * (v @ centres.T) + squares
            mine = (np.arange(len(own)), label[own])
            a = total[mine] / (n[label[own]] - 1)
            total = total / n
            total[mine] = np.inf
            b = total.min(axis=1)
            most = np.maximum(a, b)
            out[own] = np.divide(b - a, most, out=np.zeros(len(own)), where=most != 0)
        return pa.array(out, mask=gone | np.isnan(out))

    return df.withColumn("silhouette", judged(F.transform(x, lambda v: v.cast("double")), F.col(cluster)))


def separation(df: DataFrame, x: str = "x", cluster: str = "cluster") -> dict[str, float | None]:
    """Davies-Bouldin and Calinski-Harabasz, from the clusters' sums (k rows) and mean distances.

    Both are None for fewer than two clusters, the second also where every row is a cluster or the
    rows of each are equal; clusters of equal centres make the first infinite (0 if they have no spread).
    """
    sums = {r[cluster]: r for r in cluster_sums(df, x, cluster).collect()}
    if len(sums) < 2:
        return {"davies_bouldin": None, "calinski_harabasz": None}
    centres = {k: [v / r["n"] for v in r["sum"]] for k, r in sums.items()}
    table = F.lit(None).cast("array<double>")
    for k, c in centres.items():
        table = F.when(F.col(cluster) == F.lit(k), F.array(*[F.lit(float(v)) for v in c])).otherwise(table)
    d2 = F.aggregate(F.zip_with(x, table, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    spread = {r[cluster]: (r["s"], r["w"]) for r in df.groupBy(cluster).agg(F.avg(F.sqrt(d2)).alias("s"), F.sum(d2).alias("w")).collect()}
    gap = lambda a, b: sum((u - v) ** 2 for u, v in zip(centres[a], centres[b])) ** 0.5
    closeness = lambda s, g: s / g if g else (float("inf") if s else 0.0)
    worst = [max(closeness(spread[a][0] + spread[b][0], gap(a, b)) for b in centres if b != a) for a in centres]
    n, k = sum(r["n"] for r in sums.values()), len(sums)
    mean = [sum(r["sum"][i] for r in sums.values()) / n for i in range(len(next(iter(centres.values()))))]
    between = sum(r["n"] * sum((u - v) ** 2 for u, v in zip(centres[c], mean)) for c, r in sums.items())
    within = sum(w for _, w in spread.values())
    return {"davies_bouldin": sum(worst) / k, "calinski_harabasz": between / (k - 1) / (within / (n - k)) if n > k and within else None}


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labelings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = cells.agg(pairs("n").alias("ij"), F.sum("n").alias("t"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("i"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("j"))
    i, j = left.first()["i"], right.first()["j"]
    expected = F.lit(i * j) / (F.col("t") * (F.col("t") - 1) / 2)
    return both.select(((F.col("ij") - expected) / (F.lit((i + j) / 2) - expected)).alias("ari"))


def as_array(df: DataFrame, features: str = "features", out: str = "x") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(features)))


def eta_squared(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """(col, eta2): the share of each column's variance (of log1p) that lies between clusters."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.log1p(F.col(c).cast("double")).alias("v")) for c in columns])
    by = df.select(cluster, F.inline(cells)).groupBy("col", cluster).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    w = Window.partitionBy("col")
    mean = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    parts = by.withColumn("b", F.col("n") * F.pow(F.col("m") - mean, 2)).groupBy("col").agg(F.sum("b").alias("b"), F.sum(F.col("n") * F.col("s")).alias("w"))
    return parts.select("col", F.when(F.col("b") + F.col("w") > 0, F.col("b") / (F.col("b") + F.col("w"))).otherwise(0.0).alias("eta2"))
