"""Quantile regression by a forest: exact quantiles of the target in every leaf, averaged over the trees.

A row is in a leaf of every tree, but it is not moved once for each.  The target is cut into bins;
the rows of each (tree, leaf, bin) are counted where they are, which tells the bins that hold the
ranks asked for, and only the rows of those are moved.  Their share falls with the number of bins,
which follows the rows; where the bins are cut does not change a quantile.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans import ordering
from plumbline.session import durable

#: Rows of a bin, about, and the fewest bins.
BIN_ROWS, LEAST_BINS = 500_000, 32


@dataclass
class QuantileForest:
    """A fitted forest and the table (tree, leaf, q...) of its leaves' quantiles."""

    model: RandomForestRegressionModel
    leaves: DataFrame
    features: list[str]
    names: list[str]

    def predict(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        """``key`` and a column for each quantile; the key should be unique.  The leaves, at most 2 ** depth a tree, are broadcast."""
        table: dict[int, dict[int, tuple]] = {}
        for r in self.leaves.collect():  # at most 2 ** depth a tree
            table.setdefault(r["tree"], {})[r["leaf"]] = tuple(r[n] for n in self.names)
        trees = [table.get(i, {}) for i in range(max(table, default=-1) + 1)]
        lists = [[x.get(i) for i in range(max(x, default=-1) + 1)] for x in trees]
        kind = "array<array<struct<" + ", ".join(f"{n}: double" for n in self.names) + ">>>"
        leaves = df.sparkSession.createDataFrame([(lists,)], f"__leaves {kind}")
        rows = _leaves(self.model, df, self.features, key).crossJoin(F.broadcast(leaves))
        reached = F.filter(F.transform("__at", lambda leaf, tree: F.get(F.get("__leaves", tree), leaf)), lambda x: x.isNotNull())
        rows = rows.select(*key, reached.alias("__q")).where(F.size("__q") > 0)

        def total(name: str) -> Column:
            return F.aggregate("__q", F.lit(0.0), lambda done, x: done + x[name])

        sums = rows.select(*key, F.size("__q").alias("__n"), *[total(n).alias(f"__s{i}") for i, n in enumerate(self.names)])
        return sums.groupBy(*key).agg(*[(F.sum(f"__s{i}") / F.sum("__n")).alias(n) for i, n in enumerate(self.names)])


def _leaves(model: RandomForestRegressionModel, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, __at): the leaf of each tree that a row of ``df`` falls into; rows without a feature are left out."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="__f", handleInvalid="skip").transform(df.select(*dict.fromkeys([*keep, *features])))
    return model.transform(assembled).select(*keep, vector_to_array("__leaf").cast("array<int>").alias("__at"))


def leaf_quantiles(fallen: DataFrame, named: Mapping[str, float], bins: int | None = None) -> DataFrame:
    """(tree, leaf) and a column for each name: exact quantiles of ``__y`` in every leaf of ``fallen`` (__y, __at)."""
    probs = sorted({float(p) for p in named.values()})
    if bins is None:
        bins = max(LEAST_BINS, -(-fallen.count() // BIN_ROWS))
    finite = fallen.where(F.abs("__y") < float("inf"))
    cuts = finite.approxQuantile("__y", [i / bins for i in range(1, bins)], 0.25 / bins) if bins > 1 else []
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    binned = Bucketizer(splits=splits, inputCol="__y", outputCol="__bin").transform(fallen)
    laid = durable(binned.select(F.col("__y").alias("__v"), "__at", F.col("__bin").cast("int").alias("__bin")))
    laid = laid.select("__v", "__bin", F.posexplode("__at").alias("tree", "leaf"))
    group = ["tree", "leaf"]
    counts = laid.groupBy(*group, "__bin").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(*group)
    counts = counts.select("*", F.sum("c").over(whole.orderBy("__bin")).alias("end"), F.sum("c").over(whole).alias("n"))
    ranks = F.array(*[f((F.col("n") - 1) * F.lit(p)) for p in probs for f in (F.floor, F.ceil)])
    asked = counts.where(F.exists(ranks, lambda r: (r >= F.col("end") - F.col("c")) & (r < F.col("end"))))
    # Of each leaf two bins for each probability, at most.
    asked = durable(asked.select(*group, "__bin", (F.col("end") - F.col("c")).alias("before"), "n"))
    ties = laid.join(F.broadcast(asked), [*group, "__bin"]).groupBy(*group, "__bin", "before", "n", "__v").agg(F.count(F.lit(1)).alias("ties"))
    upto = F.col("before") + F.sum("ties").over(Window.partitionBy(*group, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    counted = ties.select(*group, "__v", "ties", upto.alias("upto"), "n")
    return ordering.in_columns(ordering.picked_quantiles(counted, probs, group), named, group)


def fit(df: DataFrame, features: Sequence[str], target: str, quantiles: Sequence[float] = (0.1, 0.5, 0.9), trees: int = 20, depth: int = 5, least: int = 20, seed: int = 42) -> QuantileForest:
    """Grows the forest, drops the rows through it, and takes the quantiles of each (tree, leaf) exactly."""
    names = [f"q{round(q * 100):02d}" for q in quantiles]
    rows = durable(df.select(*features, F.col(target).cast("double").alias("__y")).dropna())
    assembled = VectorAssembler(inputCols=list(features), outputCol="__f").transform(rows)
    forest = RandomForestRegressor(featuresCol="__f", labelCol="__y", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=0.7, featureSubsetStrategy="all" if len(features) < 3 else "onethird", seed=seed)
    model = forest.setLeafCol("__leaf").fit(assembled)
    leaves = leaf_quantiles(_leaves(model, rows, features, ["__y"]), dict(zip(names, quantiles)))
    return QuantileForest(model, durable(leaves), list(features), names)
