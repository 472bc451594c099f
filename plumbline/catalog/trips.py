"""The trip fact and other bindings of the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPS_SQL = """
trips AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS custkey, o_orderdate AS pickup, l_shipdate AS dropoff,
    date_diff('day', o_orderdate, l_shipdate)::BIGINT AS duration, l_quantity AS distance, l_extendedprice AS fare,
    l_discount AS discount, l_returnflag AS rate, l_linestatus AS status, o_orderpriority AS priority,
    cn.n_name AS pickup_zone, cr.r_name AS pickup_borough, sn.n_name AS dropoff_zone, sr.r_name AS dropoff_borough,
    hour(o_orderdate)::BIGINT AS hour, isodow(o_orderdate)::BIGINT AS dow, strftime(o_orderdate, '%Y-%m') AS month
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey)
"""
#: Trips that pass the ledger's rules.
KEPT_SQL = TRIPS_SQL + """,
kept AS (SELECT * FROM trips WHERE duration > 0 AND duration <= 1500 AND distance > 0 AND distance <= 45 AND fare > 1000)
"""


def zones(t) -> DataFrame:
    """Nations with their region's name: fixed in size, so broadcast."""
    return F.broadcast(t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))


def trips(t) -> DataFrame:
    z = zones(t)
    pickup = z.select(F.col("n_nationkey").alias("pk"), F.col("n_name").alias("pickup_zone"), F.col("r_name").alias("pickup_borough"))
    dropoff = z.select(F.col("n_nationkey").alias("dk"), F.col("n_name").alias("dropoff_zone"), F.col("r_name").alias("dropoff_borough"))
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(pickup), F.col("c_nationkey") == F.col("pk"))
        .join(F.broadcast(dropoff), F.col("s_nationkey") == F.col("dk"))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("pickup"),
            F.col("l_shipdate").alias("dropoff"), F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("duration"),
            F.col("l_quantity").alias("distance"), F.col("l_extendedprice").alias("fare"), F.col("l_discount").alias("discount"),
            F.col("l_returnflag").alias("rate"), F.col("l_linestatus").alias("status"), F.col("o_orderpriority").alias("priority"),
            "pickup_zone", "pickup_borough", "dropoff_zone", "dropoff_borough",
            F.hour("o_orderdate").cast("bigint").alias("hour"), (F.weekday("o_orderdate") + 1).cast("bigint").alias("dow"),
            F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    )


def rules() -> dict:
    """The ledger's rules, in order."""
    return {
        "duration is not positive": F.col("duration") > 0,
        "duration is over 1500": F.col("duration") <= 1500,
        "distance is not positive": F.col("distance") > 0,
        "distance is over 45": F.col("distance") <= 45,
        "fare is 1000 or less": F.col("fare") > 1000,
    }


def kept(t) -> DataFrame:
    out = trips(t)
    for holds in rules().values():
        out = out.where(holds)
    return out


def scored(t) -> DataFrame:
    """(label, score, segment, region): urgent orders, and a score that follows from the total price."""
    z = zones(t)
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(z, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("bigint").alias("label"),
            (F.pmod(F.floor("o_totalprice"), F.lit(1000)) / 1000.0).alias("score"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"),
            F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("ts"))
    )


SCORED_SQL = """
scored AS (
  SELECT o_orderkey AS id, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::BIGINT AS label,
    (floor(o_totalprice)::BIGINT % 1000) / 1000.0::DOUBLE AS score, c_mktsegment AS segment, r_name AS region, o_totalprice AS price, o_orderdate AS ts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
