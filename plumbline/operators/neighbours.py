"""Exact neighbourhoods of points in a few dimensions: nearest neighbours, outlier factor, density clusters.

Points are rows (id, x), x an array of up to MAX_DIMENSIONS doubles.  Space is cut into blocks
or cells, and only points of near ones ever meet.  Equal points are one point with a weight, named by their
least id, so copies are never paired.  Points with null, NaN or infinite components are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import segments
from plumbline.plans import ordering
from plumbline.plans.components import components
from plumbline.session import durable

MAX_DIMENSIONS = 4
#: Points of a block, at least; rows of a block that are compared at a time; points that ask one copy of a block.
BLOCK, ROWS, ASKED = 512, 128, 1 << 15
#: Sides of the cells, in eps, by which points without enough rows around them are left out.
WIDTHS = (4, 1)
#: So much wider than they need be are these cells, that rounding leaves no pair out.
WIDER = 1.01
#: What a distance is stretched by before a box is left out.
SLACK = 1 + 1e-9


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))


def _between(a: str, b: str, dimensions: int) -> Column:
    """``distance``, added up in the same order, by columns that Spark compiles."""
    gaps = [F.col(a)[i] - F.col(b)[i] for i in range(dimensions)]
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def _written(df: DataFrame) -> DataFrame:
    """``durable``, and joined by shuffles only: cells, points and distances pack so well that their files'
    size says little about what a broadcast table of them takes of the driver."""
    return durable(df).hint("merge")


def distinct_points(df: DataFrame, key: str, x: str) -> tuple[DataFrame, DataFrame, int]:
    """(p, x, w): distinct points, the least id and the number of rows of each; (id, p); and the number of dimensions."""
    values = F.transform(F.col(x), lambda v: v.cast("double") + 0.0)  # one zero
    rows = df.select(F.col(key).alias("id"), values.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    rows = _written(rows)
    sizes = [r["d"] for r in rows.select(F.size("x").alias("d")).distinct().limit(2).collect()]
    if len(sizes) > 1 or (sizes and not 1 <= sizes[0] <= MAX_DIMENSIONS):
        raise ValueError(f"points must all have the same number of components, from 1 to {MAX_DIMENSIONS}; project them first")
    points = _written(rows.groupBy("x").agg(F.min("id").alias("p"), F.count(F.lit(1)).alias("w")).select("p", "x", "w"))
    return points, _written(rows.join(points.select("p", "x"), "x").select("id", "p")), sizes[0] if sizes else 1


def _cell(x: Column | str, side: Column | float) -> Column:
    return F.transform(x, lambda v: F.floor(v / side))


def _around(cell: Column | str, offsets: Sequence[Sequence[int]]) -> Column:
    """The cells at ``offsets`` from a cell."""
    moves = F.array(*[F.array(*[F.lit(o).cast("bigint") for o in offset]) for offset in offsets])
    return F.transform(moves, lambda m: F.zip_with(cell, m, lambda c, o: c + o))


def _blocks(points: DataFrame, dimensions: int, size: int) -> DataFrame:
    """(block, rn, p, x, w): the points along a curve that keeps near ones together, cut into runs of ``size`` to 2 * ``size``."""
    low = points.agg(*[f(F.col("x")[i]) for f in (F.min, F.max) for i in range(dimensions)], F.count(F.lit(1))).first()
    mins = np.array(low[:dimensions], float)
    span = float((np.array(low[dimensions:-1], float) - mins).max()) or 1.0
    bits = 60 // dimensions
    schema = T.StructType([*[points.schema[c] for c in ("p", "x", "w")], T.StructField("z", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.minimum((_values(b.column(1), dimensions) - mins) / span * (1 << bits), (1 << bits) - 1).astype(np.int64)
            z = np.zeros(len(at), np.int64)
            for bit in range(bits):
                for i in range(dimensions):
                    z |= (at[:, i] >> bit & 1) << (bit * dimensions + i)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z)], names=schema.names)

    laid = ordering.row_numbers(points.select("p", "x", "w").mapInArrow(run, schema), [F.col("z"), F.col("p")])
    n = max(1, low[-1] // size)
    return durable(laid.select(F.floor((F.col("rn") - 1) * n / F.lit(low[-1])).cast("int").alias("block"), "rn", "p", "x", "w"))


def _values(x: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    whole = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distances of all rows of ``x`` from all of ``y``, added up as ``distance`` does."""
    total = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        gap = x[:, i, None] - y[:, i]
        total += gap * gap
    return np.sqrt(total)


def nearest(points: DataFrame, k: int, dimensions: int, size: int = BLOCK) -> DataFrame:
    """(p, q, d, w, kdist): for each point its k nearest rows, all at the k-th distance ``kdist`` included.

    ``points`` is (p, x, w); q is another point with all its w rows, or the point itself with its
    other rows.  Points lie in blocks of near ones.  The k-th distance inside its own block bounds a
    point's k-th distance, so it asks its block and those whose boxes this distance reaches, and
    each gives its k nearest.  Rows grow with the points; a block that many ask is copied for each ASKED of them.
    """
    spark = points.sparkSession
    if points.isEmpty():
        return points.select("p", F.col("p").alias("q"), F.lit(0.0).alias("d"), "w", F.lit(0.0).alias("kdist"))
    laid = _blocks(points, dimensions, max(size, 2 * k))
    edges = [f(F.col("x")[i]) for f in (F.min, F.max) for i in range(dimensions)]
    found = sorted(tuple(r) for r in laid.groupBy("block").agg(*edges).collect())  # a row for each block
    boxes = spark.sparkContext.broadcast((np.array([r[0] for r in found], np.int32), np.array([r[1:] for r in found], float)))
    asks = T.StructType([T.StructField("to", T.IntegerType()), *[laid.schema[c] for c in ("rn", "p", "x")], T.StructField("reach", T.DoubleType())])

    def ask(t: pa.Table) -> pa.Table:
        x, w = _values(t["x"], dimensions), t["w"].to_numpy()
        names, edges = boxes.value
        reach = np.empty(len(x))
        most = min(k + 1, len(x))
        for at in range(0, len(x), ROWS):
            d = _apart(x[at : at + ROWS], x)
            own = np.arange(len(d))
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(axis=1), 1)
            upto = (w[near] - (near == (own + at)[:, None])).cumsum(axis=1)
            first = (upto < k).sum(axis=1)
            far = np.take_along_axis(d, near, 1)[own, np.minimum(first, most - 1)]
            reach[at : at + ROWS] = np.where(first < most, far, np.inf)
        gap = lambda lo, hi: np.sqrt((np.maximum(np.maximum(edges[:, :dimensions] - hi, lo - edges[:, dimensions:]), 0) ** 2).sum(axis=-1))
        some = np.flatnonzero(gap(x.min(axis=0), x.max(axis=0)) <= reach.max() * SLACK)
        edges, rows, to = edges[some], [], []
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS, None]
            i, j = np.nonzero(gap(part, part) <= (reach[at : at + ROWS] * SLACK)[:, None])
            rows.append(i + at)
            to.append(names[some[j]])
        rows = np.concatenate(rows)
        return pa.Table.from_arrays([pa.array(np.concatenate(to)), *[t[c].combine_chunks().take(pa.array(rows)) for c in ("rn", "p", "x")], pa.array(reach[rows])], names=asks.names)

    tasks = 2 * spark.sparkContext.defaultParallelism
    asked = durable(laid.repartition(tasks, "block").groupBy("block").applyInArrow(ask, asks))
    copies = asked.groupBy(F.col("to").alias("block")).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("copies"))
    copies = durable(copies.select(F.col("block").alias("to"), "copies"))
    here = asked.join(copies, "to").withColumn("copy", F.pmod("rn", "copies").cast("int"))
    there = laid.withColumnRenamed("block", "to").join(copies, "to").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    kind = laid.schema["p"].dataType
    schema = T.StructType([T.StructField("p", kind), T.StructField("q", kind), T.StructField("d", T.DoubleType()), T.StructField("w", T.LongType())])

    def answer(one: pa.Table, two: pa.Table) -> pa.Table:
        x, y = _values(one["x"], dimensions), _values(two["x"], dimensions)
        rn, rn2, w, reach = one["rn"].to_numpy(), two["rn"].to_numpy(), two["w"].to_numpy(), one["reach"].to_numpy()
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        for at in range(0, len(x) if len(y) else 0, ROWS):
            d = _apart(x[at : at + ROWS], y)
            v = w - (rn[at : at + ROWS, None] == rn2)
            d[v == 0] = np.inf
            bound = reach[at : at + ROWS]
            if len(y) > k:
                bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero((d <= bound[:, None]) & (v > 0))
            found.append((i + at, j, d[i, j], v[i, j]))
        i, j, d, v = (np.concatenate(c) for c in zip(*found))
        return pa.Table.from_arrays([one["p"].combine_chunks().take(pa.array(i)), two["p"].combine_chunks().take(pa.array(j)), pa.array(d), pa.array(v)], names=schema.names)

    here, there = (df.repartition(tasks, "to", "copy").groupBy("to", "copy") for df in (here.select("to", "copy", "rn", "p", "x", "reach"), there.select("to", "copy", "rn", "p", "x", "w")))
    pairs = here.cogroup(there).applyInArrow(answer, schema)
    by = Window.partitionBy("p").orderBy("d")
    pairs = pairs.withColumn("r", F.rank().over(by)).where(F.col("r") <= k).drop("r")
    pairs = pairs.withColumn("before", F.coalesce(F.sum("w").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.sum("w").over(Window.partitionBy("p", "d")))
    kept = pairs.where(F.col("before") < k)
    return durable(kept.select("p", "q", "d", "w", F.max("d").over(Window.partitionBy("p")).alias("kdist")))


def neighbour_table(df: DataFrame, key: str, x: str, k: int) -> DataFrame:
    """(id, q, d, w, kdist): ``nearest`` for every row of ``df``."""
    points, names, dimensions = distinct_points(df, key, x)
    return names.join(nearest(points, k, dimensions), "p").select("id", "q", "d", "w", "kdist")


def outlier_factor(df: DataFrame, key: str, x: str, k: int = 20) -> DataFrame:
    """(id, lof): the local outlier factor, about 1 inside a cluster, larger outside.

    The neighbourhood has all rows within the k-th distance.  Copies have no distance, so, as
    usual, 1e-10 is added to the mean reach before it is inverted.  A row alone has null.
    """
    points, names, dimensions = distinct_points(df, key, x)
    near = nearest(points, k, dimensions).hint("merge")
    far = near.groupBy("p").agg(F.max("kdist").alias("kdist"))
    reach = near.drop("kdist").join(far.select(F.col("p").alias("q"), "kdist"), "q", "left")
    total = F.sum(F.greatest("d", F.coalesce("kdist", F.lit(0.0))) * F.col("w"))
    density = _written(reach.groupBy("p").agg((1.0 / (total / F.sum("w") + 1e-10)).alias("density")))
    around = near.select("p", "q", "w").join(density.select(F.col("p").alias("q"), F.col("density").alias("of")), "q")
    mean = around.groupBy("p").agg((F.sum(F.col("of") * F.col("w")) / F.sum("w")).alias("mean"))
    factor = density.join(mean, "p").select("p", (F.col("mean") / F.col("density")).alias("lof"))
    return names.join(factor, "p", "left").select("id", "lof")


def density_clusters(df: DataFrame, key: str, x: str, eps: float, least: int) -> DataFrame:
    """(id, cluster, core): density clusters, -1 for noise.

    A row is core if ``least`` rows, itself included, lie within ``eps``; core rows within eps of
    each other share a cluster; any other row within eps of a core row has the cluster of the
    nearest (ties: least id).  Clusters are numbered from 0 by their least core id.
    """
    points, names, dimensions = distinct_points(df, key, x)
    found = _clusters(points, dimensions, eps, least, None)
    return names.join(found, "p").select("id", "cluster", "core")


def _crowded(at: DataFrame, points: DataFrame, dimensions: int, eps: float, least: int) -> DataFrame:
    """The rows of ``at`` around which there are ``least`` rows of ``points`` by whole cells; the others cannot have them within ``eps``.

    Large cells are counted first, so that few small ones are looked at.
    """
    offsets = list(product((-1, 0, 1), repeat=dimensions))
    for width in WIDTHS:
        cell = _cell("x", width * eps * WIDER).alias("near")
        counts = points.groupBy(cell).agg(F.sum("w").alias("n")).select(F.col("near").alias("to"), "n")
        around = at.select(cell).distinct().withColumn("to", F.explode(_around("near", offsets))).hint("merge").join(counts, "to")
        many = around.groupBy("near").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        at = _written(at.withColumn("near", cell).join(many.select("near").hint("merge"), "near", "left_semi").drop("near"))
    return at


def _clusters(points: DataFrame, dimensions: int, eps: float, least: int, known: DataFrame | None) -> DataFrame:
    """(p, cluster, core).  ``known`` are clusters (p, cluster, core) of a smaller eps: what was core or together stays so.

    Cells have a diagonal of eps, so a cell of ``least`` rows is core without any pair, and core
    points of a cell are together; cells are the nodes.  Other cells have fewer than ``least``
    points, which are joined with the cells around, so a full cell costs rows in proportion to its
    points; but only if the cells around have ``least`` rows in all: the rest cannot be core, and is
    held against core points alone.  Two full cells are first tried by the points nearest to the other's box; the pairs
    left open, and in different clusters by then, are decided by the points within eps of the
    other's box.
    """
    side = eps / dimensions**0.5 * (1 - 1e-9)
    ring = int(dimensions**0.5) + 1
    near = lambda o: sum((max(0, abs(v) - 1) * side) ** 2 for v in o) <= eps * eps
    offsets = [o for o in product(range(-ring, ring + 1), repeat=dimensions) if near(o)]
    at = points.withColumn("cell", _cell("x", side))
    cells = at.groupBy("cell").agg((F.sum("w") >= least).alias("full"))
    at = _written(at.join(cells, "cell"))
    # Pairs meet in cells of eps, of which fewer are around a point.
    wide = _cell("x", eps * WIDER)
    there = at.select(wide.alias("near"), F.col("p").alias("q"), F.col("x").alias("y"), F.col("w").alias("v"))
    crowded = _crowded(at.where("NOT full").select("p", "x", "cell"), points, dimensions, eps, least)
    sparse = crowded.select("p", "x", F.explode(_around(wide, list(product((-1, 0, 1), repeat=dimensions)))).alias("near"))
    pairs = sparse.hint("merge").join(there, "near").withColumn("d", _between("x", "y", dimensions)).where(F.col("d") <= eps)
    pairs = _written(pairs.select("p", "q", "v", "d"))
    reached = pairs.groupBy("p").agg(F.sum("v").alias("n")).where(F.col("n") >= least).select("p")
    core = at.where("full").select("p").unionByName(reached)
    if known is not None:
        core = core.unionByName(known.where("core").select("p")).distinct()
    cored = _written(at.join(core, "p").select("p", "x", "cell", "full"))
    if cored.isEmpty():
        return _written(points.select("p", F.lit(-1).cast("bigint").alias("cluster"), F.lit(False).alias("core")))
    is_core = cored.select(F.col("p").alias("q"), F.col("cell").alias("to"))
    # Cells that are together for certain.
    links = pairs.select("p", "q").join(cored.select("p", "cell"), "p").join(is_core, "q").select(F.col("cell").alias("a"), F.col("to").alias("b"))
    links = links.unionByName(cored.select(F.col("cell").alias("a"), F.col("cell").alias("b"))).distinct()
    if known is not None:
        of = cored.join(known.where("core").select("p", "cluster"), "p").select("cluster", "cell")
        links = links.unionByName(of.join(of.groupBy("cluster").agg(F.min("cell").alias("b")), "cluster").select(F.col("cell").alias("a"), "b"))
    full = cored.where("full")
    boxes = full.groupBy("cell").agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(dimensions) for n, f in (("lo", F.min), ("hi", F.max))])
    boxes = _written(boxes.select("cell", F.array(*[f"lo{i}" for i in range(dimensions)]).alias("lo"), F.array(*[f"hi{i}" for i in range(dimensions)]).alias("hi")))
    box_gap = lambda lo, hi, lo2, hi2: F.sqrt(sum((F.pow(F.greatest(lo2[i] - hi[i], lo[i] - hi2[i], F.lit(0.0)), 2) for i in range(dimensions)), F.lit(0.0)))
    other = boxes.select(F.col("cell").alias("to"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    doors = boxes.withColumn("to", F.explode(_around("cell", offsets))).join(other, "to").where(F.col("cell") != F.col("to"))
    doors = _written(doors.where(box_gap(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2")) <= eps).select("cell", "to", "lo2", "hi2"))
    to_box = F.sqrt(F.aggregate(F.zip_with("x", F.zip_with("lo2", "hi2", lambda l, h: F.struct(l.alias("l"), h.alias("h"))), lambda v, b: F.greatest(b["l"] - v, v - b["h"], F.lit(0.0))), F.lit(0.0), lambda s, v: s + v * v))
    facing = full.join(doors, "cell").withColumn("g", to_box).where(F.col("g") <= eps)
    best = _written(facing.groupBy("cell", "to").agg(F.min_by("x", F.struct("g", "p")).alias("x")))
    tried = best.join(best.select(F.col("cell").alias("to"), F.col("to").alias("cell"), F.col("x").alias("y")), ["cell", "to"]).where(F.col("cell") < F.col("to"))
    tried = _written(tried.select("cell", "to", (_between("x", "y", dimensions) <= eps).alias("linked")))
    links = _written(links.unionByName(tried.where("linked").select(F.col("cell").alias("a"), F.col("to").alias("b"))))
    labels = components(links)
    open_ = tried.where("NOT linked").select("cell", "to")
    label = lambda c, n: labels.select(F.col("node").alias(c), F.col("label").alias(n))
    open_ = _written(open_.join(label("cell", "l1"), "cell").join(label("to", "l2"), "to").where("l1 != l2").select("cell", "to"))
    if not open_.isEmpty():
        here = facing.select("cell", "to", "x").join(open_, ["cell", "to"])
        over = facing.select(F.col("cell").alias("to"), F.col("to").alias("cell"), F.col("x").alias("y")).join(open_, ["cell", "to"])
        more = here.join(over, ["cell", "to"]).where(_between("x", "y", dimensions) <= eps).select(F.col("cell").alias("a"), F.col("to").alias("b")).distinct()
        labels = components(links.unionByName(more))
    own = cored.join(labels.select(F.col("node").alias("cell"), "label"), "cell").select("p", "label")
    first = own.groupBy("label").agg(F.min("p").alias("first"))
    numbers = ordering.row_numbers(first, [F.col("first")], "rn").select("label", (F.col("rn") - 1).alias("cluster"))
    own = _written(own.join(numbers, "label").select("p", "cluster"))
    lone = at.where("NOT full").select("p", "x", "cell").join(crowded.select("p"), "p", "left_anti")
    reach = cored.select(F.col("cell").alias("to")).distinct().withColumn("cell", F.explode(_around("to", offsets)))
    beside = lone.join(reach.hint("merge"), "cell").join(cored.select(F.col("p").alias("q"), F.col("cell").alias("to"), F.col("x").alias("y")), "to")
    beside = beside.withColumn("d", _between("x", "y", dimensions)).where(F.col("d") <= eps).select("p", "q", "d")
    edge = pairs.select("p", "q", "d").unionByName(beside).join(own.select(F.col("p").alias("q"), "cluster"), "q").groupBy("p").agg(F.min(F.struct("d", "q", "cluster"))["cluster"].alias("edge"))
    out = points.select("p").join(own, "p", "left").join(edge, "p", "left")
    return _written(out.select("p", F.coalesce("cluster", "edge", F.lit(-1)).cast("bigint").alias("cluster"), F.col("cluster").isNotNull().alias("core")))


def eps_sweep(df: DataFrame, key: str, x: str, least: int, k: int = 8, shares: Sequence[float] = (0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99), max_noise: float = 0.25) -> DataFrame:
    """(share, eps, n_clusters, noise, silhouette, chosen): density clusters at quantiles of the k-th nearest distance.

    The row itself counts as its first neighbour.  Chosen is the eps of the best silhouette (of the
    rows in a cluster, two clusters at least) with at most ``max_noise`` noise; none if no eps has.
    Each eps goes on from the clusters of the one before: they can only grow and merge.
    """
    points, names, dimensions = distinct_points(df, key, x)
    far = _written(nearest(points, k - 1, dimensions).groupBy("p").agg(F.max("kdist").alias("kdist")))
    epses = ordering.quantile_list(names.join(far, "p"), "kdist", list(shares))
    rows, known = [], None
    weights = points.select("p", "w", "x")
    for share, eps in sorted(zip(shares, epses)):
        if not eps:
            continue
        known = _clusters(points, dimensions, eps, least, known)
        n, noise, clusters = known.join(points, "p").agg(F.sum("w"), F.sum(F.when(F.col("cluster") < 0, F.col("w")).otherwise(0)), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster")))).first()
        silhouette = None
        if clusters >= 2:
            found = segments.silhouettes(names.join(weights, "p").join(known, "p").where("cluster >= 0").select("x", "cluster"))
            silhouette = found.agg(F.avg("silhouette")).first()[0]
        rows.append((float(share), float(eps), int(clusters), float(noise / n), silhouette))
    fit = [(r[4], -r[0]) for r in rows if r[4] is not None and r[3] <= max_noise]
    best = max(fit, default=None)
    return df.sparkSession.createDataFrame([(*r, best is not None and (r[4], -r[0]) == best) for r in rows], "share double, eps double, n_clusters bigint, noise double, silhouette double, chosen boolean")
