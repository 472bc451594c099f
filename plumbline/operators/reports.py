"""Whole reports: one long table (section, item, measure, value, text) put together from the parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import evaluation as E
from plumbline.operators import profile as P
from plumbline.plans import ordering
from plumbline.session import durable

SCHEMA = "section string, item string, measure string, value double, text string"


def laid(df: DataFrame, section: str, *items: str) -> DataFrame:
    """A row for each measure of each row; ``items`` name the row, numbers are values, others text."""
    cells = []
    for c, kind in df.dtypes:
        if c in items:
            continue
        number = kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        value, text = (F.col(f"`{c}`").cast("double"), F.lit(None).cast("string")) if number else (F.lit(None).cast("double"), F.col(f"`{c}`").cast("string"))
        cells.append(F.struct(F.lit(c).alias("measure"), value.alias("value"), text.alias("text")))
    item = F.concat_ws("/", *[F.col(f"`{c}`").cast("string") for c in items]) if items else F.lit("all")
    return df.select(F.lit(section).alias("section"), item.alias("item"), F.inline(F.array(*cells)))


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_pairs(df: DataFrame, most: int = 8) -> DataFrame:
    """(a, b, both, share): pairs among the ``most`` columns with most nulls that are null together, and how often.

    Also the rows (*, *) for all cells and (*, complete) for complete rows, each with its share.
    """
    null = lambda c: F.col(f"`{c}`").isNull()
    cs = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(null(c)).alias(f"m{i}") for i, c in enumerate(cs)]).first()
    n = counts["n"]
    worst = sorted((c for i, c in enumerate(cs) if counts[f"m{i}"]), key=lambda c: (-counts[f"m{cs.index(c)}"], cs.index(c)))[:most]
    pairs = [(a, b) for i, a in enumerate(worst) for b in worst[i + 1 :]]
    whole = F.lit(True)
    for c in cs:
        whole = whole & ~null(c)
    got = df.agg(F.count_if(whole).alias("w"), *[F.count_if(null(a) & null(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    cells = sum(counts[f"m{i}"] for i in range(len(cs)))
    rows = [("*", "*", cells, cells / max(1, n * len(cs))), ("*", "complete", got["w"], got["w"] / max(1, n))]
    rows += [(a, b, got[f"p{i}"], got[f"p{i}"] / max(1, n)) for i, (a, b) in enumerate(pairs) if got[f"p{i}"]]
    return df.sparkSession.createDataFrame(rows, "a string, b string, both bigint, share double")


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def target_association(df: DataFrame, target: str, features: Sequence[str], key: str, classes: int = 10, top: int = 6) -> DataFrame:
    """(feature, kind, item, value): how each feature goes with the target, for looking only.

    A number of more than ``classes`` values is a numeric target, anything else one of classes.
    By both types: ``numeric-vs-numeric`` (pearson, spearman), ``numeric-by-class`` (the mean in
    each class, and ``separation``, the largest less the least), ``rate-by-category`` (the rate of
    the last class in the ``top`` categories, and ``spread`` over all), ``target-mean-by-category``
    (the target's mean in the ``top`` categories).  Null cells are left out.
    """
    numeric = _numeric(df, target) and df.select(target).where(F.col(target).isNotNull()).distinct().limit(classes + 1).count() > classes
    numbers = [c for c in features if c != target and _numeric(df, c)]
    groups = [c for c in features if c != target and not _numeric(df, c)]
    parts, schema = [], ["feature", "kind", "item", "value"]
    if numbers and numeric:
        own = df.select(key, F.col(target).alias("__t"), *numbers)
        for name, table in (("pearson", P.pearson(own, ["__t", *numbers])), ("spearman", P.spearman(own, key, ["__t", *numbers]))):
            parts.append(table.where("a = '__t'").select(F.col("b").alias("feature"), F.lit("numeric-vs-numeric").alias("kind"), F.lit(name).alias("item"), F.col("r").alias("value")))
    elif numbers:
        long = P.long_numeric(df, numbers, [target]).where(F.col("v").isNotNull() & F.col(target).isNotNull())
        means = long.groupBy(F.col("col").alias("feature"), F.col(target).cast("string").alias("item")).agg(F.avg("v").alias("value"))
        parts.append(means.select("feature", F.lit("numeric-by-class").alias("kind"), "item", "value"))
        parts.append(means.groupBy("feature").agg((F.max("value") - F.min("value")).alias("value")).select("feature", F.lit("numeric-by-class").alias("kind"), F.lit("separation").alias("item"), "value"))
    if groups:
        cells = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("item")) for c in groups]))
        y = F.col(target).cast("double")
        if not numeric:
            last = df.agg(F.max(target)).first()[0]
            y = F.when(F.col(target).isNotNull(), (F.col(target) == F.lit(last)).cast("double"))
        kind = "target-mean-by-category" if numeric else "rate-by-category"
        means = df.select(y.alias("y"), cells).where("y IS NOT NULL AND item IS NOT NULL").groupBy("feature", "item").agg(F.avg("y").alias("value"))
        place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("value"), "item"))
        parts.append(means.withColumn("r", place).where(F.col("r") <= top).select("feature", F.lit(kind).alias("kind"), "item", "value"))
        if not numeric:
            parts.append(means.groupBy("feature").agg((F.max("value") - F.min("value")).alias("value")).select("feature", F.lit(kind).alias("kind"), F.lit("spread").alias("item"), "value"))
    return _all(parts).select(*schema) if parts else df.sparkSession.createDataFrame([], "feature string, kind string, item string, value double")


def full_profile(df: DataFrame, key: str, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None, target: str | None = None, order: str | None = None, rules: Mapping[str, str] | None = None, bins: int = 28) -> DataFrame:
    """(section, item, measure, value, text): shape, types, numeric and categorical profiles, histograms,
    frequent values, both correlations, missing cells and pairs, quality, and association with a target.

    Repeated column names keep their first column; ``key`` names the rows.  Sections of no column are absent.
    """
    names = list(dict.fromkeys(df.columns))
    if len(names) < len(df.columns):
        df = df.toDF(*[f"{c}#{i}" if c in df.columns[:i] else c for i, c in enumerate(df.columns)]).select(*names)
    df = durable(df)
    numbers = list(dict.fromkeys(numeric)) if numeric is not None else [c for c in names if c != key and _numeric(df, c)]
    words = list(dict.fromkeys(categorical)) if categorical is not None else [c for c in names if c != key and df.schema[c].dataType.simpleString() in ("string", "boolean")]
    types = df.sparkSession.createDataFrame([(c, k, i) for i, (c, k) in enumerate(df.dtypes)], "col string, type string, place bigint")
    parts = [laid(df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(names))), "shape"), laid(types, "types", "col")]
    if numbers:
        parts += [laid(P.numeric_profile(df, numbers), "numeric", "col"), laid(P.clipped_histogram(df, numbers, bins), "histogram", "col", "bin")]
    if words:
        parts += [laid(P.categorical_profile(df, words), "categorical", "col"), laid(P.top_values(df, words), "frequent", "col", "rank")]
    if len(numbers) > 1:
        parts += [laid(P.pearson(df, numbers), "pearson", "a", "b"), laid(P.spearman(df, key, numbers), "spearman", "a", "b")]
    parts += [laid(P.missingness(df), "missing", "col"), laid(missing_pairs(df), "missing together", "a", "b")]
    parts.append(laid(P.scorecard(df, [key], rules or {}, order or key, words), "quality", "dimension"))
    if target:
        parts.append(laid(target_association(df, target, [c for c in [*numbers, *words] if c != target], key), "target", "feature", "kind", "item"))
    return _all(parts)


def classification_report(df: DataFrame, tie: str, label: str = "label", score: str = "score", threshold: float = 0.5, cost_fn: float = 1.0, cost_fp: float = 1.0, bins: int = 10) -> DataFrame:
    """(section, item, measure, value, text): ranking, metrics at a threshold, losses, curves, sweep, calibration, gain and histogram.

    Rows without a finite score or a label are left out and counted.  The table of distinct scores
    is made and written once for what needs it.
    """
    s = F.col(score).cast("double")
    fine = F.col(label).isNotNull() & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    left_out = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("left_out"))
    rows = durable(df.where(fine).select(F.col(tie).alias("tie"), F.col(label).cast("bigint").alias("label"), s.alias("score")))
    table = durable(E.score_table(rows))
    bins_ = durable(E.calibration(rows, bins))
    return _all([
        laid(left_out, "rows"), laid(E.ranking_metrics(table), "ranking"), laid(E.threshold_metrics(E.confusion(rows, threshold)), "threshold"),
        laid(E.probability_losses(rows), "losses"), laid(E.curves(table), "curves", "score"), laid(E.sweep(rows, cost_fn, cost_fp), "sweep", "threshold"),
        laid(bins_, "calibration", "bin"), laid(E.calibration_error(bins_), "calibration error"),
        laid(E.gain(rows, "tie", [i / 10 for i in range(1, 11)]), "gain", "share"), laid(E.histogram(rows, "score", 0.0, 1.0, 24, ["label"]), "histogram", "label", "bin")])
