"""Splits, folds and fitted transformers over the orders and trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.evaluation import _round
from plumbline.catalog.registry import query
from plumbline.catalog.relational import _HASH
from plumbline.catalog.trips import KEPT_SQL, SCORED_SQL, kept, scored
from plumbline.operators import features as FE
from plumbline.operators import splits as S
from plumbline.session import durable

_H = _HASH.format(seed=42, key="id")
_STRAT = f"WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_H}, id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM scored)"


@query("spl1_stratified", "SPL-1", f"{_STRAT} SELECT id, label, CASE WHEN rn <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r")
def _(t):
    return S.stratified(scored(t).select("id", "label"), "id", "label", 0.2)


@query("spl2_chronological", "SPL-2 SPL-7", f"WITH {SCORED_SQL} SELECT id, CASE WHEN row_number() OVER (ORDER BY ts, id) <= floor(count(*) OVER () * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM scored")
def _(t):
    out = S.chronological(scored(t).select("id", "ts"), [F.col("ts"), F.col("id")], 0.2)
    return out.select("id", "part")


@query("spl3_by_group", "SPL-3 SPL-8", f"WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY {_HASH.format(seed=42, key='o_custkey')}, o_custkey) AS rn, count(*) OVER () AS n FROM g) SELECT o_orderkey, o_custkey, CASE WHEN rn <= greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'train' END AS part FROM orders JOIN r USING (o_custkey)")
def _(t):
    return S.by_group(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 0.2)


@query("spl4_purged_folds", "SPL-4", """WITH r AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), f AS (SELECT unnest([1, 2, 3, 4]) AS fold),
x AS (SELECT fold, CASE WHEN i < fold * (n // 5) - 10 THEN 'train' WHEN i >= fold * (n // 5) + 5 AND i < CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END THEN 'validation' END AS part FROM r, f)
SELECT fold, part, count(*) AS n FROM x WHERE part IS NOT NULL GROUP BY 1, 2""")
def _(t):
    out = S.purged_folds(t.orders.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 4, 10, 5)
    return out.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query("spl5_folds", "SPL-5", f"{_STRAT} SELECT id, label, (rn - 1) % 5 AS fold FROM r")
def _(t):
    return S.folds(scored(t).select("id", "label"), "id", "label", 5)


@query("spl6_shared_keys", "SPL-6 SPL-8", f"{_STRAT}, p AS (SELECT segment, CASE WHEN rn <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r) SELECT segment FROM p GROUP BY 1 HAVING count(DISTINCT part) > 1")
def _(t):
    return S.shared_keys(S.stratified(scored(t).select("id", "label", "segment"), "id", "label", 0.2), "segment")


@query("spl9_description", "SPL-9", f"{_STRAT}, p AS (SELECT CASE WHEN rn <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r) SELECT part, count(*) AS n, round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY 1")
def _(t):
    return _round(S.describe(S.stratified(scored(t).select("id", "label"), "id", "label", 0.2)), 6)


_CUT = "TIMESTAMP '1999-01-01'"


def _halves(t, columns=None):
    """Early and late trips; of ``columns`` if they are read several times, and so written once."""
    k, cut = durable(kept(t).select(*columns, "pickup")) if columns else kept(t), F.lit("1999-01-01").cast("timestamp_ntz")
    return k.where(F.col("pickup") < cut), k.where(F.col("pickup") >= cut)


_KEY = ("l_orderkey", "l_linenumber", "l_partkey")
_SPLIT = f"WITH {KEPT_SQL}, tr AS (SELECT * FROM kept WHERE pickup < {_CUT} AND pickup_zone <> 'NATION_5'), te AS (SELECT * FROM kept WHERE pickup >= {_CUT})"


@query("fe1_frequency", "FE-1 UDF-4", f"{_SPLIT}, f AS (SELECT pickup_zone, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM tr) AS v FROM tr GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(v, 0), 8) AS zone_freq FROM te LEFT JOIN f USING (pickup_zone)")
def _(t):
    train, test = _halves(t)
    f = FE.fit_frequency(train.where("pickup_zone <> 'NATION_5'"), "pickup_zone")
    return f.transform(test).select(*_KEY, F.round("pickup_zone_freq", 8).alias("zone_freq"))


@query("fe2_rare", "FE-2", f"{_SPLIT}, f AS (SELECT pickup_zone AS k FROM tr GROUP BY 1 HAVING count(*) >= 0.04::DOUBLE * (SELECT count(*) FROM tr)) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(k, '__rare__') AS pickup_zone FROM te LEFT JOIN f ON pickup_zone = k")
def _(t):
    train, test = _halves(t)
    f = FE.fit_rare(train.where("pickup_zone <> 'NATION_5'"), "pickup_zone", 0.04)
    return f.transform(test).select(*_KEY, "pickup_zone")


def _scaled(kind: str, a: str, b: str, expression: str):
    sql = f"{_SPLIT}, m AS (SELECT {a} AS a, {b} AS b FROM tr) SELECT l_orderkey, l_linenumber, l_partkey, round({expression}, 6) + 0.0 AS fare FROM te, m"

    def run(t):
        train, test = _halves(t)
        f = FE.fit_columns(train.where("pickup_zone <> 'NATION_5'"), kind, ["fare"])
        return f.transform(test).select(*_KEY, (F.round("fare", 6) + 0.0).alias("fare"))

    return sql, run


for _name, _ids, _kind, _a, _b, _expression in (
    ("fe3_winsor", "FE-3", "winsor", "quantile_cont(fare, 0.001)", "quantile_cont(fare, 0.999)", "least(greatest(fare, a), b)"),
    ("fe7_standard", "FE-7", "standard", "avg(fare)", "stddev_pop(fare)", "(fare - a) / b"),
    ("fe8_robust", "FE-8", "robust", "median(fare)", "quantile_cont(fare, 0.95) - quantile_cont(fare, 0.05)", "(fare - a) / b"),
    ("fe9_log_standard", "FE-9", "log_standard", "avg(ln(1 + fare))", "stddev_pop(ln(1 + fare))", "(ln(1 + fare) - a) / b"),
):
    _sql, _run = _scaled(_kind, _a, _b, _expression)
    query(_name, _ids, _sql)(_run)


@query("fe4_median_imputer", "FE-4", f"{_SPLIT}, m AS (SELECT median(fare) FILTER (l_orderkey % 3 <> 0) AS a FROM tr) SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_orderkey % 3 = 0 THEN a ELSE fare END, 4) AS fare FROM te, m")
def _(t):
    holes = lambda df: df.withColumn("fare", F.when(F.col("l_orderkey") % 3 != 0, F.col("fare")))
    train, test = _halves(t)
    f = FE.fit_columns(holes(train.where("pickup_zone <> 'NATION_5'")), "median", ["fare"])
    return f.transform(holes(test)).select(*_KEY, F.round("fare", 4).alias("fare"))


@query("fe5_mode_imputer", "FE-5", f"{_SPLIT}, m AS (SELECT priority AS k FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 4 = 0 THEN k ELSE priority END AS priority FROM te, m")
def _(t):
    train, test = _halves(t)
    f = FE.fit_mode(train.where("pickup_zone <> 'NATION_5'"), "priority")
    return f.transform(test.withColumn("priority", F.when(F.col("l_orderkey") % 4 != 0, F.col("priority")))).select(*_KEY, "priority")


@query("fe6_one_hot", "FE-6", f"{_SPLIT}, f AS (SELECT pickup_zone AS k, row_number() OVER (ORDER BY pickup_zone) AS i FROM tr GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(i, 0)::BIGINT AS zone FROM te LEFT JOIN f ON pickup_zone = k")
def _(t):
    train, test = _halves(t)
    f = FE.fit_one_hot(train.where("pickup_zone <> 'NATION_5'"), "pickup_zone")
    return f.transform(test).select(*_KEY, F.col("pickup_zone_index").alias("zone"))


@query("fe11_trip_features", "FE-11 FE-13", f"WITH {KEPT_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round(fare / distance, 6) AS fare_per_unit, round(ln(1 + fare), 6) AS log_fare, pickup_borough = dropoff_borough AS same_borough, dow >= 6 AS weekend FROM kept")
def _(t):
    return kept(t).select(*_KEY, F.round(F.col("fare") / F.col("distance"), 6).alias("fare_per_unit"), F.round(F.log1p("fare"), 6).alias("log_fare"), (F.col("pickup_borough") == F.col("dropoff_borough")).alias("same_borough"), (F.col("dow") >= 6).alias("weekend"))


@query("fe10_branches", "FE-10 SPL-10", f"{_SPLIT}, f AS (SELECT pickup_zone AS z, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM tr) AS v FROM tr GROUP BY 1), m AS (SELECT avg(fare) AS a, stddev_pop(fare) AS b FROM tr) SELECT l_orderkey, l_linenumber, l_partkey, round((fare - a) / b, 6) + 0.0 AS fare, round(coalesce(v, 0), 8) AS pickup_zone_freq FROM te LEFT JOIN f ON pickup_zone = z, m")
def _(t):
    """A numeric and a frequency branch side by side; columns in neither are left out."""
    train, test = _halves(t, [*_KEY, "fare", "pickup_zone"])
    train = train.where("pickup_zone <> 'NATION_5'")
    S.require_absent(["fare", "pickup_zone"], ["duration", "dropoff"])
    out = test
    for f in (FE.fit_columns(train, "standard", ["fare"]), FE.fit_frequency(train, "pickup_zone")):
        out = f.transform(out)
    return out.select(*_KEY, (F.round("fare", 6) + 0.0).alias("fare"), F.round("pickup_zone_freq", 8).alias("pickup_zone_freq"))


@query("fe12_customer_features", "FE-12 FE-14", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS log_balance, CASE WHEN c_acctbal > 0 AND c_acctbal <= 3000 THEN 'low' WHEN c_acctbal > 3000 AND c_acctbal <= 7000 THEN 'mid' WHEN c_acctbal > 7000 AND c_acctbal <= 10000 THEN 'high' END AS band, (c_mktsegment IN ('BUILDING', 'MACHINERY'))::BIGINT AS industrial FROM customer")
def _(t):
    from plumbline.operators import relational as R

    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.round(F.log1p(F.greatest(b, F.lit(0.0))), 6).alias("log_balance"), R.binned(b, [0, 3000, 7000, 10000], ["low", "mid", "high"]).alias("band"), R.membership_count([F.col("c_mktsegment")], ["BUILDING", "MACHINERY"]).alias("industrial"))
