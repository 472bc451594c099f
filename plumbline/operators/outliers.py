"""Outlier detectors: isolation forest, one-class hyperplane, robust covariance, and what deviates.

Rows with a null or NaN feature are not learned from and have a null score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.plans import ordering
from plumbline.session import durable

TREES, SAMPLE, SEED = 220, 4096, 42
_NODES = "tree int, node int, feature string, threshold double, left int, size bigint, depth int, sample bigint"
EULER = 0.5772156649015329


def complete(df: DataFrame, features: Sequence[str]) -> Column:
    """Whether a row has all features."""
    out = F.lit(True)
    for c in features:
        v = F.col(c).cast("double")
        out = out & v.isNotNull() & ~F.isnan(v)
    return out


def average_path(n: np.ndarray | int) -> np.ndarray:
    """The mean depth of an unsuccessful search in a random tree over n rows, which depths are measured by."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    out = 2 * (np.log(np.maximum(m - 1, 1)) + EULER) - 2 * (m - 1) / m
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, out))


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, int]]:
    """(feature, threshold, left, size, depth) of each node; feature -1 at leaves, right is left + 1.

    A node splits on a random feature that varies in it, at a random value between its extremes.
    """
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple[int, float, int, int, int]] = [(-1, 0.0, -1, len(x), 0)]
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        depth = nodes[at][4]
        if len(rows) <= 1 or depth >= limit:
            continue
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if not len(varying):
            continue
        f = int(varying[rng.integers(len(varying))])
        cut = float(rng.uniform(low[f], high[f]))
        below = x[rows, f] < cut
        if not below.any():  # the cut is the least value
            cut = float(np.nextafter(low[f], np.inf))
            below = x[rows, f] < cut
        left = len(nodes)
        nodes[at] = (f, cut, left, len(rows), depth)
        nodes += [(-1, 0.0, -1, int(below.sum()), depth + 1), (-1, 0.0, -1, int((~below).sum()), depth + 1)]
        todo += [(left, rows[below]), (left + 1, rows[~below])]
    return nodes


@dataclass
class IsolationForest:
    """The node table: tree, node, feature (null at leaves), threshold, left (right is left + 1), size, depth, sample."""

    nodes: DataFrame
    features: list[str]

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, features: Sequence[str]) -> IsolationForest:
        return IsolationForest(spark.read.parquet(path), list(features))

    @staticmethod
    def fit(df: DataFrame, key: str, features: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> IsolationForest:
        """Each tree grows from its own ``sample`` rows, the least by its own hash of the key, in one group.

        ``key`` should be unique; of repeated keys either row may be taken.
        """
        rows = df.where(complete(df, features)).select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
        n = rows.count()
        top = 1 << 40
        # A few more than are needed, so that hardly ever a tree has fewer rows than asked for.
        share = min(1.0, (sample + 8 * sample**0.5) / max(n, 1))
        h = lambda t: F.pmod(F.xxhash64("key", t, F.lit(seed)), F.lit(top))
        chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: h(t) < int(share * top))
        dealt = rows.select("key", "x", F.explode(chosen).alias("tree")).withColumn("h", h(F.col("tree")))
        place = F.row_number().over(Window.partitionBy("tree").orderBy("h", "key"))
        dealt = dealt.withColumn("place", place).where(F.col("place") <= sample)
        names = list(features)

        def run(table: pa.Table) -> pa.Table:
            order = np.argsort(np.array(table["place"]), kind="stable")
            x = np.array(table["x"].combine_chunks().flatten()).reshape(table.num_rows, len(names))[order]
            tree = table["tree"][0].as_py()
            nodes = grow(x, np.random.default_rng((seed, tree)))
            columns = list(zip(*nodes))
            return pa.table({
                "tree": pa.array([tree] * len(nodes), pa.int32()), "node": pa.array(range(len(nodes)), pa.int32()),
                "feature": pa.array([names[f] if f >= 0 else None for f in columns[0]], pa.string()), "threshold": pa.array(columns[1], pa.float64()),
                "left": pa.array(columns[2], pa.int32()), "size": pa.array(columns[3], pa.int64()), "depth": pa.array(columns[4], pa.int32()),
                "sample": pa.array([table.num_rows] * len(nodes), pa.int64())})

        return IsolationForest(durable(dealt.groupBy("tree").applyInArrow(run, _NODES)), names)

    def scored(self, df: DataFrame, key: str) -> DataFrame:
        """(key, path, score): the mean depth over the trees, and 2 to the power of minus depth over its average.

        The nodes, at most twice the sample for each tree, are broadcast.
        """
        names = {c: i for i, c in enumerate(self.features)}
        trees: dict[int, tuple[np.ndarray, ...]] = {}
        whole = self.nodes.toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
        tree = np.array(whole["tree"])
        feature = np.array([names.get(f, -1) for f in whole["feature"].to_pylist()], np.int16)
        end = np.array(whole["depth"]) + average_path(np.array(whole["size"]))
        for t in np.unique(tree):
            at = slice(*np.searchsorted(tree, (t, t + 1)))
            trees[int(t)] = (feature[at], np.array(whole["threshold"])[at], np.array(whole["left"])[at], end[at])
        depth = int(np.array(whole["depth"]).max()) if len(tree) else 0
        scale = float(average_path(int(np.array(whole["sample"]).max()))) if len(tree) else 0.0
        shared = df.sparkSession.sparkContext.broadcast(list(trees.values()))
        rows = df.select(F.col(key).alias("key"), F.when(complete(df, self.features), F.array(*[F.col(c).cast("double") for c in self.features])).alias("x"))
        width = len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = np.array(b.column(1).is_valid())
                x = np.array(b.column(1).drop_null().flatten()).reshape(-1, width)
                total, line = np.zeros(len(x)), np.arange(len(x))
                for feature, threshold, left, end in shared.value:
                    node = np.zeros(len(x), np.int64)
                    for _ in range(depth):
                        f = feature[node]
                        down = left[node] + (x[line, np.maximum(f, 0)] >= threshold[node])
                        node = np.where(f >= 0, down, node)
                    total += end[node]
                path = np.full(len(good), np.nan)
                path[good] = total / max(1, len(shared.value))
                score = 2.0 ** (-path / scale) if scale else np.where(good, 0.5, np.nan)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, pa.float64(), from_pandas=True) for v in (path, score)]], names=[key, "path", "score"])

        return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, path double, score double")


def _dot(features: Sequence[str], weights: Sequence[float]) -> Column:
    return sum((F.col(c).cast("double") * float(w) for c, w in zip(features, weights)), F.lit(0.0))


#: Sums of doubles in this type do not depend on the order of the rows.
_EXACT = "decimal(38,14)"


@dataclass
class Hyperplane:
    """A one-class linear model: rows with weights . x under ``offset`` are outside."""

    features: list[str]
    weights: list[float]
    offset: float
    losses: list[float]

    def score(self) -> Column:
        """Larger is stranger; over 0 is outside."""
        return F.lit(self.offset) - _dot(self.features, self.weights)


def one_class(df: DataFrame, features: Sequence[str], nu: float, steps: int = 12) -> Hyperplane:
    """Minimises |w|^2 / 2 - r + mean(max(0, r - w . x)) / nu by sub-gradients.

    A step is two aggregates: the sub-gradient, and the loss at a row of step lengths along it, of
    which the best is taken, so the loss never rises.  Sums are exact, so the weights are the same
    for any partitioning.  At last the offset is the nu-quantile of w . x, exactly.
    """
    names = list(features)
    rows = durable(df.where(complete(df, names)).select(*[F.col(c).cast("double").alias(c) for c in names]))
    exact = lambda c: F.sum(c.cast(_EXACT))
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[exact(F.col(c)).alias(c) for c in names]).first()
    n = first["n"]
    if not n:
        raise ValueError("no complete row to learn from")
    w, r = np.array([float(first[c]) / n for c in names]), 0.0

    def losses(tries: Sequence[tuple[np.ndarray, float]]) -> list[float]:
        sums = rows.agg(*[exact(F.greatest(F.lit(float(t)) - _dot(names, v), F.lit(0.0))).alias(f"l{i}") for i, (v, t) in enumerate(tries)]).first()
        return [float(v @ v) / 2 - t + float(sums[i]) / (nu * n) for i, (v, t) in enumerate(tries)]

    path = losses([(w, r)])
    for _ in range(steps):
        out = _dot(names, w) < float(r)
        got = rows.where(out).agg(F.count(F.lit(1)).alias("n"), *[exact(F.col(c)).alias(c) for c in names]).first()
        slope = w - np.array([float(got[c] or 0) for c in names]) / (nu * n)
        tilt = -1.0 + got["n"] / (nu * n)
        tries = [(w - 2.0**-i * slope, r - 2.0**-i * tilt) for i in range(-1, 9)]
        found = losses(tries)
        best = int(np.argmin(found))
        if found[best] >= path[-1] - 1e-12:
            break
        (w, r), path = tries[best], [*path, found[best]]
    offset = ordering.quantile_list(rows.select(_dot(names, w).alias("v")), "v", [nu])[0]
    return Hyperplane(names, [float(v) for v in w], float(offset), path)


class SingularCovariance(ValueError):
    """The features are linearly dependent, so distances are not defined."""


def moments(df: DataFrame, features: Sequence[str], around: Sequence[float] | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and (population) covariances, in one aggregate around ``around``, which should be near the means."""
    names = list(features)
    if around is None:
        first = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).first()
        around = [v or 0.0 for v in first]
    at = [F.col(c).cast("double") - float(m) for c, m in zip(names, around)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    got = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m{i}") for i, a in enumerate(at)], *[F.avg(at[i] * at[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    shift = np.array([got[f"m{i}"] or 0.0 for i in range(len(names))])
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = (got[f"c{i}_{j}"] or 0.0) - shift[i] * shift[j]
    return got["n"], np.array(around) + shift, cov


@dataclass
class Envelope:
    """Centre and inverse covariance of the rows kept, and how many rows were kept at each step."""

    features: list[str]
    mean: np.ndarray
    covariance: np.ndarray
    kept: list[int]

    def distance(self) -> Column:
        """The squared Mahalanobis distance."""
        return _quadratic(self.features, self.mean, self.covariance)


def _quadratic(names: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    scale = np.sqrt(np.diag(cov))
    if not np.all(scale > 0) or np.linalg.cond(cov / np.outer(scale, scale)) > 1e10:
        raise SingularCovariance(f"the covariance of {', '.join(names)} is singular")
    inverse = np.linalg.inv(cov)
    at = [F.col(c).cast("double") - float(m) for c, m in zip(names, mean)]
    out = F.lit(0.0)
    for i in range(len(names)):
        for j in range(len(names)):
            out = out + at[i] * at[j] * float(inverse[i, j])
    return out


def envelope(df: DataFrame, features: Sequence[str], support: float = 0.9, steps: int = 20) -> Envelope:
    """A robust centre and covariance: keep the ``support`` share of rows that are nearest, estimate anew, until nothing changes.

    The determinant falls with every step.  Raises SingularCovariance before anything is scored.
    """
    names = list(features)
    rows = durable(df.where(complete(df, names)).select(*[F.col(c).cast("double").alias(c) for c in names]))
    n, mean, cov = moments(rows, names)
    kept = [n]
    for _ in range(steps):
        far = rows.withColumn("__d", _quadratic(names, mean, cov))
        cut = ordering.quantile_list(far, "__d", [support])[0]
        n, new, cov2 = moments(far.where(F.col("__d") <= F.lit(cut)), names, mean)
        same = n == kept[-1] and np.allclose(new, mean, rtol=1e-12, atol=0) and np.allclose(cov2, cov, rtol=1e-10, atol=0)
        mean, cov = new, cov2
        kept.append(n)
        if same:
            break
    _quadratic(names, mean, cov)
    return Envelope(names, mean, cov, kept)


def _melted(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    return df.select(*keep, F.inline(cells))


def flagged_deviation(df: DataFrame, features: Sequence[str], flagged: Column, top: int = 18) -> DataFrame:
    """(feature, median, flagged_median, iqr, deviation): how far the flagged rows' median lies from all rows', in interquartile ranges.

    The ``top`` features by size; a feature without spread has the difference itself.
    """
    cells = _melted(df.withColumn("__flag", F.coalesce(flagged, F.lit(False))), features, "__flag").where(F.col("value").isNotNull())
    all_ = ordering.quantile_columns(cells, "value", {"median": 0.5, "q1": 0.25, "q3": 0.75}, ["feature"])
    some = ordering.quantile_columns(cells.where("__flag"), "value", {"flagged_median": 0.5}, ["feature"])
    iqr = F.col("q3") - F.col("q1")
    out = all_.join(some, "feature").withColumn("iqr", iqr)
    out = out.withColumn("deviation", (F.col("flagged_median") - F.col("median")) / F.when(iqr > 0, iqr).otherwise(1.0))
    return out.select("feature", "median", "flagged_median", "iqr", "deviation").orderBy(F.desc(F.abs("deviation")), "feature").limit(top)


def deviating(df: DataFrame, key: str, features: Sequence[str], top: int = 5) -> DataFrame:
    """(key, feature, value, deviation, place): for each row its ``top`` features by distance from the median, in ranges."""
    cells = _melted(df, features, key).where(F.col("value").isNotNull())
    of = ordering.quantile_columns(cells, "value", {"median": 0.5, "low": 0.0, "high": 1.0}, ["feature"])
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    far = cells.join(F.broadcast(of), "feature").withColumn("deviation", (F.col("value") - F.col("median")) / span)  # a row for each feature
    best = Window.partitionBy(key).orderBy(F.desc(F.abs("deviation")), "feature")
    return far.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).select(key, "feature", "value", "deviation", "place")
