"""Scans, projections, filters, joins, aggregates, sorts, samples, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.catalog.registry import query
from plumbline.catalog.trips import KEPT_SQL, TRIPS_SQL, kept, rules, trips, zones
from plumbline.functions import geo
from plumbline.operators import relational as R
from plumbline.plans import ordering


# ---------------------------------------------------------------- scans and text formats

@query("src1_parquet_scan", "SRC-1", "SELECT * FROM supplier")
def _(t):
    return t.supplier


@query("src2_parquet_columns", "SRC-2", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice")


@query("src3_csv_roundtrip", "SRC-3 SNK-2", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    schema = "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string"
    rows = t.customer.select(F.to_csv(F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment")).alias("line"))
    return rows.select(F.from_csv("line", schema).alias("r")).select("r.*")


@query("src4_csv_na_values", "SRC-4", """
SELECT p_partkey, nullif(p_type, 'ECONOMY') AS p_type, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END::BIGINT AS p_size FROM part WHERE p_partkey % 11 <> 0""")
def _(t):
    """Lines with ``?`` for missing values, and comment lines, which are skipped."""
    line = F.concat_ws(", ", F.col("p_partkey").cast("string"), F.when(F.col("p_type") == "ECONOMY", "?").otherwise(F.col("p_type")),
                       F.when(F.col("p_size") % 7 == 0, "?").otherwise(F.col("p_size").cast("string")))
    lines = t.part.select(F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("|"), line)).otherwise(line).alias("line"))
    parsed = lines.where(~F.col("line").startswith("|")).select(F.from_csv(
        "line", "p_partkey bigint, p_type string, p_size bigint",
        {"nullValue": "?", "ignoreLeadingWhiteSpace": "true"}).alias("r"))
    return parsed.select("r.*")


@query("src5_text_lines", "SRC-5 SNK-1", """
SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("snk3_json_results", "SNK-3 SC-12", """
SELECT c_custkey, c_mktsegment AS segment, round(c_acctbal / 7, 6) AS balance, NULL::DOUBLE AS bad FROM customer""")
def _(t):
    """Results as JSON (NaN and infinities null, six digits), and read back."""
    bad = F.lit(float("nan"))
    clean = lambda c: F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), F.round(c, 6))
    rows = t.customer.select(F.to_json(F.struct("c_custkey", F.col("c_mktsegment").alias("segment"), clean(F.col("c_acctbal") / 7).alias("balance"), clean(bad).alias("bad")),).alias("j"))
    return rows.select(F.from_json("j", "c_custkey bigint, segment string, balance double, bad double").alias("r")).select("r.*")


@query("snk4_manifest", "SNK-4 SNK-6 PRF-20", """
SELECT name, n_rows, n_columns FROM (VALUES ('orders', (SELECT count(*) FROM orders), 6), ('customer', (SELECT count(*) FROM customer), 5), ('part', (SELECT count(*) FROM part), 6)) v(name, n_rows, n_columns)""")
def _(t):
    from plumbline.sources.manifest import manifest, upsert

    found = manifest(t.orders, "orders").unionByName(manifest(t.customer, "customer"))
    stale = manifest(t.part.limit(0), "part")
    return upsert(found.unionByName(stale), manifest(t.part, "part")).select("name", "n_rows", "n_columns")


# ---------------------------------------------------------------- projections and filters

@query("prj1_select_reorder", "PRJ-1", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer")
def _(t):
    return t.customer.select("c_mktsegment", "c_custkey", "c_acctbal")


@query("prj2_rename_all", "PRJ-2", "SELECT s_suppkey AS suppkey, s_name AS supplier_name, s_acctbal AS balance FROM supplier")
def _(t):
    raw = t.supplier.select(F.col("s_suppkey").alias(" Suppkey "), F.col("s_name").alias("Supplier Name"), F.col("s_acctbal").alias("BALANCE"))
    return raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])


@query("prj3_guarded_division", "PRJ-3", f"WITH {TRIPS_SQL} SELECT l_orderkey, l_linenumber, duration, CASE WHEN duration > 0 THEN round(distance / duration, 6) END AS speed FROM trips")
def _(t):
    speed = R.guarded_ratio(F.col("distance"), F.col("duration"))
    return trips(t).select("l_orderkey", "l_linenumber", "duration", F.round(speed, 6).alias("speed"))


@query("prj4_conditional", "PRJ-4", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def _(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p > 300000, "high").when(p > 100000, "mid").otherwise("low").alias("band"))


@query("prj5_coerce_number", "PRJ-5", "SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_totalprice::VARCHAR END AS DOUBLE) AS amount FROM orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.select("o_orderkey", R.to_number(text).alias("amount"))


@query("prj6_fill_null", "PRJ-6 PRJ-7 SC-13", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'Unknown') AS segment FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment")).fillna({"segment": "Unknown"})


@query("prj7_sentinels", "PRJ-7", "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN NULL ELSE p_type END AS kind FROM part")
def _(t):
    return t.part.select("p_partkey", F.when(~F.col("p_type").isin("ECONOMY", "SMALL"), F.col("p_type")).alias("kind"))


@query("prj8_value_map", "PRJ-8", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'Unknown' END AS rate FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", R.mapped(F.col("l_returnflag"), {"A": "accepted", "R": "returned"}, "Unknown").alias("rate"))


@query("prj9_fixed_bins", "PRJ-9", "SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 12 THEN 'a' WHEN p_size > 12 AND p_size <= 24 THEN 'b' WHEN p_size > 24 AND p_size <= 48 THEN 'c' END AS size_band FROM part")
def _(t):
    return t.part.select("p_partkey", R.binned(F.col("p_size"), [0, 12, 24, 48], ["a", "b", "c"]).alias("size_band"))


@query("prj10_membership_count", "PRJ-10", "SELECT l_orderkey, l_linenumber, l_partkey, ((l_returnflag IN ('A', 'F'))::BIGINT + (l_linestatus IN ('A', 'F'))::BIGINT) AS n FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", R.membership_count([F.col("l_returnflag"), F.col("l_linestatus")], ["A", "F"]).alias("n"))


@query("prj11_drop_columns", "PRJ-11", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    return t.orders.drop("o_custkey", "o_orderdate", "o_orderpriority")


@query("flt1_compound_filter", "FLT-1", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05 AND l_returnflag = 'R'")
def _(t):
    return t.lineitem.where((F.col("l_quantity") > 25) & (F.col("l_discount") < 0.05) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("flt2_expression_filter", "FLT-2", "SELECT o_orderkey FROM orders WHERE o_totalprice > 0 AND o_totalprice <= 180000 AND o_orderstatus <> 'P'")
def _(t):
    return t.orders.where("o_totalprice > 0 and o_totalprice <= 180000 and o_orderstatus <> 'P'").select("o_orderkey")


@query("flt3_exclusion_ledger", "FLT-3 FLT-4", f"""
WITH {TRIPS_SQL}, c AS (
  SELECT CASE WHEN NOT coalesce(duration > 0, false) THEN 1 WHEN NOT coalesce(duration <= 1500, false) THEN 2 WHEN NOT coalesce(distance > 0, false) THEN 3
    WHEN NOT coalesce(distance <= 45, false) THEN 4 WHEN NOT coalesce(fare > 1000, false) THEN 5 ELSE 0 END AS step FROM trips),
n AS (SELECT step, count(*) AS n FROM c GROUP BY step)
SELECT r.step, r.rule, coalesce(n, 0)::BIGINT AS n_rows, round(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM trips), 4) AS pct_of_raw
FROM (VALUES (0, 'kept'), (1, 'duration is not positive'), (2, 'duration is over 1500'), (3, 'distance is not positive'), (4, 'distance is over 45'), (5, 'fare is 1000 or less')) r(step, rule)
LEFT JOIN n ON n.step = r.step""")
def _(t):
    return R.exclusion_ledger(trips(t), rules())


@query("flt4_exclusion_summary", "FLT-4", f"WITH {KEPT_SQL} SELECT (SELECT count(*) FROM trips) AS n_raw, (SELECT count(*) FROM kept) AS n_kept, (SELECT count(*) FROM trips) - (SELECT count(*) FROM kept) AS n_removed")
def _(t):
    kept_ = F.col("f").isNull().cast("bigint")
    return trips(t).select(R.first_failure(rules()).alias("f")).agg(
        F.count(F.lit(1)).alias("n_raw"), F.sum(kept_).alias("n_kept"), F.sum(1 - kept_).alias("n_removed"))


@query("flt5_label_whitelist", "FLT-5", "SELECT o_orderkey, rtrim(o_orderpriority, '.') AS label FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def _(t):
    label = F.rtrim(F.concat("o_orderpriority", F.lit(".")), F.lit("."))
    return t.orders.select("o_orderkey", label.alias("label")).where(F.col("label").isin("1-URGENT", "5-LOW"))


@query("flt6_contains", "FLT-6", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def _(t):
    return t.part.where(F.col("p_name").contains("ring")).select("p_partkey", "p_name")


# ---------------------------------------------------------------- joins

@query("join1_lookup", "JOIN-1", """
SELECT c_custkey, coalesce(n_name, 'Unknown') AS zone, coalesce(r_name, 'Unknown') AS borough
FROM customer LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20) ON c_nationkey = n_nationkey""")
def _(t):
    return R.lookup(t.customer, zones(t).where("n_nationkey < 20"), {"c_nationkey": "n_nationkey"}, {"zone": "n_name", "borough": "r_name"}, "Unknown").select("c_custkey", "zone", "borough")


@query("join2_train_mean", "JOIN-2 REG-7", f"""
WITH {KEPT_SQL}, tr AS (SELECT * FROM kept WHERE pickup < TIMESTAMP '1999-01-01'), m AS (SELECT pickup_zone, avg(duration) AS a FROM tr WHERE pickup_zone <> 'NATION_3' GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(a, (SELECT avg(duration) FROM tr WHERE pickup_zone <> 'NATION_3')), 4) AS expected
FROM kept LEFT JOIN m USING (pickup_zone) WHERE pickup >= TIMESTAMP '1999-01-01'""")
def _(t):
    k = kept(t)
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    train = k.where((F.col("pickup") < cut) & (F.col("pickup_zone") != "NATION_3"))
    out = R.with_fallback(k.where(F.col("pickup") >= cut), train, ["pickup_zone"], F.col("duration"), "expected")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("expected", 4).alias("expected"))


@query("join3_composite_key", "JOIN-3", f"""
WITH {KEPT_SQL}, m AS (SELECT pickup_borough, dropoff_borough, avg(duration) AS a FROM kept GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, round(duration - a, 4) AS residual FROM kept JOIN m USING (pickup_borough, dropoff_borough)""")
def _(t):
    k = kept(t)
    m = k.groupBy("pickup_borough", "dropoff_borough").agg(F.avg("duration").alias("a"))
    return k.join(m, ["pickup_borough", "dropoff_borough"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("duration") - F.col("a"), 4).alias("residual"))


@query("join4_semi", "JOIN-4", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join5_anti", "JOIN-5", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def _(t):
    return t.part.join(t.lineitem.where("l_quantity > 48"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("join6_spine", "JOIN-6 TS-1", """
WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour)
SELECT s.hour, n FROM s LEFT JOIN h USING (hour)""")
def _(t):
    from plumbline.operators.series import hourly

    return hourly(t.events, "ts", {"n": F.count(F.lit(1))}).select("hour", "n")


@query("join9_grid", "JOIN-9", """
SELECT a.r_name AS pickup_borough, b.r_name AS dropoff_borough, count(l_orderkey) AS n
FROM region a CROSS JOIN region b LEFT JOIN (
  SELECT l_orderkey, cr.r_name AS p, sr.r_name AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  WHERE l_quantity > 49 AND cr.r_name <> 'ASIA') x ON a.r_name = p AND b.r_name = d GROUP BY 1, 2""")
def _(t):
    names = sorted(r[0] for r in t.region.select("r_name").distinct().collect())  # five
    counts = trips(t).where((F.col("distance") > 49) & (F.col("pickup_borough") != "ASIA")).groupBy("pickup_borough", "dropoff_borough").agg(F.count(F.lit(1)).alias("n"))
    return R.completed(counts, {"pickup_borough": names, "dropoff_borough": names}, {"n": 0})


# ---------------------------------------------------------------- aggregates

@query("agg1_by_key", "AGG-1", f"WITH {KEPT_SQL} SELECT pickup_zone, count(*) AS n, round(avg(duration), 4) AS mean_duration, round(median(duration), 4) AS median_duration FROM kept GROUP BY 1")
def _(t):
    k = kept(t)
    means = k.groupBy("pickup_zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 4).alias("mean_duration"))
    medians = ordering.quantile_columns(k, "duration", {"m": 0.5}, ["pickup_zone"])
    return means.join(medians, "pickup_zone").select("pickup_zone", "n", "mean_duration", F.round("m", 4).alias("median_duration"))


@query("agg2_two_keys", "AGG-2", f"WITH {KEPT_SQL} SELECT pickup_borough, dropoff_borough, round(avg(fare), 4) AS mean_fare FROM kept GROUP BY 1, 2")
def _(t):
    return kept(t).groupBy("pickup_borough", "dropoff_borough").agg(F.round(F.avg("fare"), 4).alias("mean_fare"))


@query("agg3_distinct_count", "AGG-3", "SELECT l_partkey, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n_orders"))


@query("agg5_pivot", "AGG-5", """
SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 4) AS mean_f, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 4) AS mean_o,
  count(*) FILTER (l_linestatus = 'F') AS n_f, count(*) FILTER (l_linestatus = 'O') AS n_o FROM lineitem GROUP BY 1""")
def _(t):
    p = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_quantity"), 4).alias("m"), F.count(F.lit(1)).alias("n"))
    return p.select("l_returnflag", F.col("F_m").alias("mean_f"), F.col("O_m").alias("mean_o"), F.col("F_n").alias("n_f"), F.col("O_n").alias("n_o"))


@query("agg6_crosstab", "AGG-6", """
SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS share
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def _(t):
    cells = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("segment"))
    return cells.select("segment", "status", "n", F.round(F.col("n") / total, 6).alias("share"))


@query("agg7_group_floor", "AGG-7", "SELECT l_partkey, count(*) AS n, round(avg(l_quantity), 4) AS mean_quantity FROM lineitem GROUP BY 1 HAVING count(*) >= 30")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity")).where("n >= 30")


@query("agg8_stacked", "AGG-8", """
SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), round(avg(o_totalprice), 2) FROM orders GROUP BY 2""")
def _(t):
    return R.stacked(t.orders, ["o_orderstatus", "o_orderpriority"], [F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price")])


@query("agg9_conditional_counts", "AGG-9", "SELECT count(*) AS n, count_if(l_quantity > 25 AND l_returnflag = 'R') AS big_returned, count_if(l_discount = 0) AS no_discount FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("l_quantity") > 25) & (F.col("l_returnflag") == "R")).alias("big_returned"), F.count_if(F.col("l_discount") == 0).alias("no_discount"))


@query("agg10_quantiles", "AGG-10", "SELECT p AS prob, round(quantile_cont(value, p), 6) AS quantile FROM events, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) v(p) GROUP BY p".replace("quantile_cont(value, p)", "any_value(CASE p WHEN 0.05 THEN q[1] WHEN 0.25 THEN q[2] WHEN 0.5 THEN q[3] WHEN 0.75 THEN q[4] ELSE q[5] END)").replace("FROM events,", "FROM (SELECT quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM events),").replace("SELECT p AS prob", "SELECT p::DOUBLE AS prob"))
def _(t):
    return ordering.quantiles(t.events, "value", [0.05, 0.25, 0.5, 0.75, 0.95]).select("prob", F.round("quantile", 6).alias("quantile"))


@query("agg11_months", "AGG-11", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_orderkey) AS n_orders, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_distinct("o_orderkey").alias("n_orders"), F.count(F.lit(1)).alias("n_lines"))


@query("agg13_share", "AGG-13", "SELECT event_type, count(*) AS n, round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def _(t):
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return counts.select("event_type", "n", F.round(F.col("n") / F.lit(total), 6).alias("share"))


# ---------------------------------------------------------------- windows, sorts, samples

@query("win4_cumulative_share", "WIN-4 BSK-18", """
WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, n, round(sum(n) OVER (ORDER BY n DESC, l_partkey ROWS UNBOUNDED PRECEDING) * 1.0::DOUBLE / sum(n) OVER (), 8) AS share FROM c""")
def _(t):
    counts = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    cum = ordering.cumulate(counts, [-F.col("n"), F.col("l_partkey")], {"upto": F.col("n")})
    total = counts.agg(F.sum("n")).first()[0]
    return cum.select("l_partkey", "n", F.round(F.col("upto") / F.lit(total), 8).alias("share"))


@query("win5_rank_quintile", "WIN-5", """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER () AS n FROM customer)
SELECT c_custkey, rn, CASE WHEN rn <= 1 + (n - 1) * 0.2 THEN 1 WHEN rn <= 1 + (n - 1) * 0.4 THEN 2 WHEN rn <= 1 + (n - 1) * 0.6 THEN 3 WHEN rn <= 1 + (n - 1) * 0.8 THEN 4 ELSE 5 END AS quintile FROM r""")
def _(t):
    r = ordering.with_group_size(ordering.row_numbers(t.customer.select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")]), [])
    edge = lambda k: F.col("rn") <= 1 + (F.col("n") - 1) * k / 5
    return r.select("c_custkey", "rn", F.when(edge(1), 1).when(edge(2), 2).when(edge(3), 3).when(edge(4), 4).otherwise(5).alias("quintile"))


@query("win6_value_quintile", "WIN-6", """
WITH q AS (SELECT quantile_cont(p_size, [0.2, 0.4, 0.6, 0.8]) AS q FROM part)
SELECT p_partkey, CASE WHEN p_size <= q[1] THEN 5 WHEN p_size <= q[2] THEN 4 WHEN p_size <= q[3] THEN 3 WHEN p_size <= q[4] THEN 2 ELSE 1 END AS score FROM part, q""")
def _(t):
    edges = ordering.quantile_list(t.part, "p_size", [0.2, 0.4, 0.6, 0.8])
    s = F.col("p_size")
    return t.part.select("p_partkey", F.when(s <= edges[0], 5).when(s <= edges[1], 4).when(s <= edges[2], 3).when(s <= edges[3], 2).otherwise(1).alias("score"))


@query("win7_rank_normalised", "WIN-7", "SELECT event_id, round((row_number() OVER (ORDER BY value, event_id) - 1) * 1.0::DOUBLE / (count(*) OVER () - 1), 8) AS r FROM events")
def _(t):
    r = ordering.with_group_size(ordering.row_numbers(t.events.select("event_id", "value"), [F.col("value"), F.col("event_id")]), [])
    return r.select("event_id", F.round((F.col("rn") - 1) / (F.col("n") - 1), 8).alias("r"))


@query("win8_percent_rank", "WIN-8", """
WITH c AS (SELECT p_size, count(*) AS ties FROM part GROUP BY 1), u AS (SELECT p_size, ties, sum(ties) OVER (ORDER BY p_size) AS upto FROM c)
SELECT p_size, round((upto - (ties - 1) / 2.0::DOUBLE) / (SELECT count(*) FROM part), 8) AS pct FROM u""")
def _(t):
    n = t.part.count()
    return ordering.average_ranks(t.part, "p_size").select("p_size", F.round(F.col("rank") / n, 8).alias("pct"))


@query("win10_position_cut", "WIN-10 SPL-2", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part FROM orders")
def _(t):
    r = ordering.with_group_size(ordering.row_numbers(t.orders.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")]), [])
    return r.select("o_orderkey", F.when(F.col("rn") <= F.floor(F.col("n") * 0.8), "train").otherwise("test").alias("part"))


@query("srt1_sort", "SRT-1", "SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_brand, p_retailprice DESC, p_partkey")
def _(t):
    return t.part.select("p_partkey", "p_brand", "p_retailprice").orderBy("p_brand", F.desc("p_retailprice"), "p_partkey")


@query("srt2_top_k", "SRT-2", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 12")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(12)


@query("srt3_top_k_per_group", "SRT-3", """
SELECT pickup_borough, pickup_zone, n FROM (
  SELECT *, row_number() OVER (PARTITION BY pickup_borough ORDER BY n DESC, pickup_zone) AS rn FROM (
    SELECT r_name AS pickup_borough, n_name AS pickup_zone, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)) WHERE rn <= 3""")
def _(t):
    c = t.customer.join(zones(t), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("pickup_borough"), F.col("n_name").alias("pickup_zone")).agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(Window.partitionBy("pickup_borough").orderBy(F.desc("n"), "pickup_zone"))
    return c.withColumn("rn", rn).where("rn <= 3").drop("rn")


@query("srt4_top_share", "SRT-4", "SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS rn, count(*) OVER () AS n FROM events) WHERE rn <= ceil(n * 0.01)")
def _(t):
    r = ordering.with_group_size(ordering.row_numbers(t.events.select("event_id", "value"), [-F.col("value"), F.col("event_id")]), [])
    return r.where(F.col("rn") <= F.ceil(F.col("n") * 0.01)).select("event_id", "value")


@query("srt5_monotonic", "SRT-5", "SELECT count(*) FILTER (ts < prev) AS n_descents FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS prev FROM events)")
def _(t):
    """Descents between neighbours by id: inside ranges of ids, and between the ranges' ends."""
    e = t.events.select("event_id", "ts", F.floor(F.col("event_id") / 1000).alias("b"))
    inside = e.withColumn("prev", F.lag("ts").over(Window.partitionBy("b").orderBy("event_id"))).agg(F.count_if(F.col("ts") < F.col("prev")).alias("n"))
    ends = e.groupBy("b").agg(F.min_by("ts", "event_id").alias("first"), F.max_by("ts", "event_id").alias("last"))
    seams = ordering.row_numbers(ends, [F.col("b")])
    seam = seams.alias("x").join(seams.alias("y"), F.col("x.rn") == F.col("y.rn") + 1).agg(F.count_if(F.col("x.first") < F.col("y.last")).alias("n"))
    return inside.unionByName(seam).agg(F.sum("n").alias("n_descents"))


@query("srt6_tail", "SRT-6", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def _(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500)


_HASH = "('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 15))::BIGINT"


@query("smp1_sample", "SMP-1", f"SELECT o_orderkey FROM orders ORDER BY {_HASH.format(seed=42, key='o_orderkey')} LIMIT 1000")
def _(t):
    return t.orders.select("o_orderkey").orderBy(ordering.portable_hash(F.col("o_orderkey"))).limit(1000)


@query("smp2_decimate", "SMP-2", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id FROM r WHERE i IN (SELECT round(k * (n - 1) / 219.0)::BIGINT FROM range(220) g(k), (SELECT count(*) AS n FROM events))""")
def _(t):
    r = ordering.with_group_size(ordering.row_numbers(t.events.select("event_id"), [F.col("event_id")]), [])
    n, i = F.col("n") - 1, F.col("rn") - 1
    nearest = F.round(F.round(i * 219 / F.greatest(n, F.lit(1))) * n / 219.0).cast("bigint")
    return r.where(nearest == i).select("event_id")


@query("smp3_subsample", "SMP-3", f"SELECT o_orderkey FROM orders WHERE {_HASH.format(seed=7, key='o_orderkey')} % 1000 < 800")
def _(t):
    return t.orders.where(ordering.portable_hash(F.col("o_orderkey"), 7) % 1000 < 800).select("o_orderkey")


@query("smp4_box", "SMP-4", f"""
WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT c_custkey, round(lo + (hi - lo) * ({_HASH.format(seed=3, key='c_custkey')} % 1000000) / 1000000.0::DOUBLE, 4) AS u FROM customer, b""")
def _(t):
    lo, hi = t.customer.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    u = (ordering.portable_hash(F.col("c_custkey"), 3) % 1000000) / 1000000.0
    return t.customer.select("c_custkey", F.round(F.lit(lo) + F.lit(hi - lo) * u, 4).alias("u"))


# ---------------------------------------------------------------- sets

@query("set1_union_by_name", "SET-1", "SELECT o_orderkey, o_totalprice, 'early' AS origin FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice, 'late' FROM orders WHERE o_orderkey % 2 = 1")
def _(t):
    o = t.orders
    early = o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice", F.lit("early").alias("origin"))
    late = o.where("o_orderkey % 2 = 1").select(F.lit("late").alias("origin"), "o_totalprice", "o_orderkey")
    return early.unionByName(late)


@query("set2_distinct_pairs", "SET-2", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("set4_intersection", "SET-4", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").intersect(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("set5_domain_union", "SET-5", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nationkey"))).distinct()


@query("set6_duplicates", "SET-6", "SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def _(t):
    return R.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- scalar functions

@query("sc1_strings", "SC-1", "SELECT p_partkey, upper(trim(p_name)) AS name, replace(p_brand, 'Brand#', 'B') AS brand, starts_with(p_type, 'S') AS s FROM part")
def _(t):
    return t.part.select("p_partkey", F.upper(F.trim("p_name")).alias("name"), F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("brand"), F.startswith("p_type", F.lit("S")).alias("s"))


@query("sc3_date_parts", "SC-3 SC-5 SC-6", """
SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, isodow(o_orderdate)::BIGINT AS dow, (isodow(o_orderdate) >= 6) AS weekend,
  strftime(o_orderdate, '%Y-%m') AS period, last_day(o_orderdate)::VARCHAR AS month_end FROM orders""")
def _(t):
    d, big = F.col("o_orderdate"), lambda c, n: c.cast("bigint").alias(n)
    return t.orders.select("o_orderkey", big(F.year(d), "y"), big(F.month(d), "m"), big(F.weekday(d) + 1, "dow"), (F.weekday(d) >= 5).alias("weekend"), F.date_format(d, "yyyy-MM").alias("period"), F.last_day(d).cast("string").alias("month_end"))


@query("sc4_date_arithmetic", "SC-4", "SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate)::BIGINT AS days, (o_orderdate + INTERVAL 30 DAY)::DATE::VARCHAR AS due FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("days"), F.date_add("o_orderdate", 30).cast("string").alias("due"))


@query("sc7_math", "SC-7 SC-8", """
SELECT event_id, round(ln(1 + value), 6) AS l, round(sqrt(value), 6) AS s, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos FROM events WHERE value >= 0""")
def _(t):
    sin, cos = geo.cyclical(F.hour("ts"), 24)
    return t.events.where("value >= 0").select("event_id", F.round(F.log1p("value"), 6).alias("l"), F.round(F.sqrt("value"), 6).alias("s"), (F.round(sin, 6) + 0.0).alias("hour_sin"), (F.round(cos, 6) + 0.0).alias("hour_cos"))


_PLACE = "(n_nationkey * 7 % 180 - 90)::DOUBLE AS lat, (n_nationkey * 13 % 360 - 180)::DOUBLE AS lon"


@query("sc9_great_circle", "SC-9 SC-10", f"""
WITH p AS (SELECT n_nationkey, n_regionkey, {_PLACE} FROM nation)
SELECT a.n_nationkey AS a, b.n_nationkey AS b,
  round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 4) AS km,
  round(((degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360) % 360), 4) AS bearing
FROM p a JOIN p b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def _(t):
    p = t.nation.select("n_nationkey", "n_regionkey", (F.col("n_nationkey") * 7 % 180 - 90).cast("double").alias("lat"), (F.col("n_nationkey") * 13 % 360 - 180).cast("double").alias("lon"))
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    where = [F.col(c) for c in ("a.lat", "a.lon", "b.lat", "b.lon")]
    return pairs.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.round(geo.great_circle_km(*where), 4).alias("km"), F.round(geo.bearing(*where), 4).alias("bearing"))


@query("sc11_arrays", "SC-11", "SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags_list, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1".replace("list_sort(list(DISTINCT l_returnflag)) AS flags_list", "array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags"))
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("a")).select("l_orderkey", F.array_join("a", ",").alias("flags"), F.size("a").cast("bigint").alias("n"))


@query("sc12_json", "SC-12", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
