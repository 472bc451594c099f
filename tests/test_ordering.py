"""Order statistics are the same for any number of partitions, and those of a plain window."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.plans import ordering


@pytest.fixture(scope="module")
def rows(spark):
    v = (F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 101 == 0, float("nan")).when(F.col("id") % 103 == 0, float("inf"))
         .when(F.col("id") % 107 == 0, -float("inf")).when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 1000).cast("double")))
    g = F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2)
    return spark.range(6000).select("id", v.alias("v"), g.alias("g"))


@pytest.mark.parametrize("partitions", [1, 3, 50])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_row_numbers(rows, partitions, group):
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("v", "id")
    expected = {r["id"]: r["rn"] for r in rows.withColumn("rn", F.row_number().over(w)).collect()}
    got = {r["id"]: r["rn"] for r in ordering.row_numbers(rows, [F.col("v"), F.col("id")], group=group, partitions=partitions).collect()}
    assert got == expected


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_quantiles(rows, partitions):
    clean = rows.where("v is not null and not isnan(v) and abs(v) < 1e300")
    got = {(r["g"], r["prob"]): r["quantile"] for r in ordering.quantiles(clean, "v", [0.1, 0.5, 0.5, 0.99], ["g"], partitions).collect()}
    assert len(got) == 9  # three groups, null among them; a probability asked for twice comes once
    for r in clean.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("q")).collect():
        assert [got[r["g"], p] for p in (0.1, 0.5, 0.99)] == pytest.approx(r["q"])


def test_group_sizes_keep_null(rows):
    got = {r["g"]: r["n"] for r in ordering.with_group_size(rows, ["g"]).select("g", "n").distinct().collect()}
    assert got == {None: 1200, 0: 2400, 1: 2400}


def test_seeds_give_other_orders(rows):
    order = lambda seed: [r["id"] for r in rows.orderBy(ordering.portable_hash(F.col("id"), seed)).limit(50).collect()]
    assert order(1) != order(2)


def test_reserved_names(rows):
    with pytest.raises(ValueError):
        ordering.row_numbers(rows.withColumn("__ord_x", F.lit(1)), [F.col("id")])
