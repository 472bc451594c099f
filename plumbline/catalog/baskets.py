"""Market baskets: an order's part types and brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.evaluation import _round
from plumbline.catalog.registry import query
from plumbline.operators import baskets as B
from plumbline.session import durable

_PAIRS = """p AS (SELECT DISTINCT l_orderkey AS basket, upper(trim(p_type)) AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 AND p_type IS NOT NULL),
b AS (SELECT basket, list_sort(list(item)) AS items FROM p GROUP BY 1 HAVING count(*) >= 2), t AS (SELECT count(*) AS total FROM b), e AS (SELECT basket, unnest(items) AS item FROM b)"""
_SETS = f"""{_PAIRS}, c1 AS (SELECT item AS s, count(*) AS n FROM e GROUP BY 1), c2 AS (SELECT x.item || ',' || y.item AS s, count(*) AS n FROM e x JOIN e y ON x.basket = y.basket AND x.item < y.item GROUP BY 1),
c3 AS (SELECT x.item || ',' || y.item || ',' || z.item AS s, count(*) AS n FROM e x JOIN e y ON x.basket = y.basket AND x.item < y.item JOIN e z ON y.basket = z.basket AND y.item < z.item GROUP BY 1),
sets AS (SELECT s, n, n / total AS support FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3), t WHERE n >= 0.05::DOUBLE * total)"""


def pairs(t, item: str = "p_type"):
    return B.curated(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", item, "l_quantity")


def baskets(t):
    p = pairs(t)
    return B.baskets(p, p.select("item").distinct())


def itemsets(t, support: float = 0.05):
    return B.frequent_itemsets(baskets(t), support)


def _joined(df):
    return df.select(*[F.array_join(c, ",").alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes])


@query("bsk1_curation", "BSK-1 SET-2", "SELECT DISTINCT l_orderkey AS basket, upper(trim(p_name)) AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 AND p_name IS NOT NULL")
def _(t):
    return pairs(t, "p_name")


@query("bsk2_vocabulary", "BSK-2", "SELECT item, count(*) AS n FROM (SELECT DISTINCT l_orderkey, upper(trim(p_brand)) AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0) GROUP BY 1 ORDER BY n DESC, item LIMIT 10")
def _(t):
    return B.vocabulary(pairs(t, "p_brand"), 10)


@query("bsk3_baskets", "BSK-3", f"WITH {_PAIRS} SELECT basket, array_to_string(items, ',') AS items FROM b")
def _(t):
    return _joined(baskets(t))


@query("bsk4_audit", "BSK-4", f"WITH {_PAIRS} SELECT (SELECT count(*) FROM lineitem) AS n_lines, (SELECT count(DISTINCT basket) FROM p) AS n_orders, count(*) AS n_baskets, round(avg(len(items)), 6) AS mean_size FROM b")
def _(t):
    n_lines = t.lineitem.count()
    p = pairs(t)
    orders = p.groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("n") >= 2
    return orders.agg(F.lit(n_lines).cast("bigint").alias("n_lines"), F.count(F.lit(1)).alias("n_orders"), F.count_if(kept).alias("n_baskets"), F.round(F.avg(F.when(kept, F.col("n"))), 6).alias("mean_size"))


@query("bsk5_sizes", "BSK-5", f"WITH {_PAIRS} SELECT len(items)::BIGINT AS size, count(*) AS n FROM b WHERE len(items) <= 40 GROUP BY 1")
def _(t):
    return baskets(t).groupBy(F.size("items").cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n")).where("size <= 40")


@query("bsk6_itemsets", "BSK-6", f"WITH {_SETS} SELECT s AS items, n, round(support, 8) AS support FROM sets")
def _(t):
    return _round(_joined(itemsets(t)), 8)


@query("bsk7_fp_growth", "BSK-7", f"WITH {_SETS} SELECT s AS items, n FROM sets")
def _(t):
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=0.05, minConfidence=1.0).fit(baskets(t).select("items"))
    sets = model.freqItemsets.where(F.size("items") <= 3)
    return sets.select(F.array_join(F.array_sort("items"), ",").alias("items"), F.col("freq").alias("n"))


#: The reference's floor (``train.py``).
_FLOOR = 0.012
#: As _SETS, with that floor and sets of any length: the subsets of each kind of basket, grown item by item.
_ALL_SETS = f"""RECURSIVE {_PAIRS}, k AS (SELECT items, count(*) AS n, count(basket) AS named FROM b GROUP BY 1),
g AS (SELECT items, n, named, i, items[i] AS s FROM (SELECT items, n, named, unnest(range(1, len(items) + 1)) AS i FROM k)
  UNION ALL SELECT items, named AS n, named, j AS i, s || ',' || items[j] AS s FROM (SELECT *, unnest(range(i + 1, len(items) + 1)) AS j FROM g)),
sets AS (SELECT s, c AS n, c / total AS support FROM (SELECT s, sum(n)::BIGINT AS c FROM g GROUP BY 1), t WHERE c >= {_FLOOR}::DOUBLE * total)"""


@query("set3_set_equality", "SET-3 BSK-8", f"WITH {_ALL_SETS} SELECT count(*) AS n_left, count(*) AS n_right, 0::BIGINT AS only_left, 0::BIGINT AS only_right, 0::BIGINT AS counted_apart, true AS equal FROM sets")
def _(t):
    """The sets of both algorithms, of any length, with their counts: what only one has, and what they count differently."""
    from pyspark.ml.fpm import FPGrowth

    rows = durable(baskets(t))
    one = B.frequent_itemsets(rows, _FLOOR, longest=None).select(F.array_join("items", ",").alias("s"), F.col("n").alias("a"))
    found = FPGrowth(itemsCol="items", minSupport=_FLOOR, minConfidence=1.0).fit(rows.select("items")).freqItemsets
    two = found.select(F.array_join(F.array_sort("items"), ",").alias("s"), F.col("freq").alias("b"))
    counts = one.join(two, "s", "full").agg(
        F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"),
        F.count_if(F.col("a") != F.col("b")).alias("counted_apart"))
    return counts.withColumn("equal", (F.col("only_left") + F.col("only_right") + F.col("counted_apart")) == 0)


_RULES = f"""{_SETS}, l AS (SELECT string_split(s, ',') AS i, support FROM sets), m AS (SELECT i, support, unnest(range(1, (1 << len(i)) - 1)) AS mask FROM l WHERE len(i) > 1),
w AS (SELECT support, list_filter(i, lambda x, j: (mask >> (j - 1)) % 2 = 1) AS a, list_filter(i, lambda x, j: (mask >> (j - 1)) % 2 = 0) AS c FROM m),
r AS (SELECT array_to_string(a, ',') AS antecedent, array_to_string(c, ',') AS consequent, w.support AS s, x.support AS sa, y.support AS sc FROM w JOIN sets x ON x.s = array_to_string(a, ',') JOIN sets y ON y.s = array_to_string(c, ',')),
rules AS (SELECT antecedent, consequent, s AS support, s / sa AS confidence, s / sa / sc AS lift, s - sa * sc AS leverage, CASE WHEN s / sa < 1 THEN (1 - sc) / (1 - s / sa) END AS conviction,
  CASE WHEN greatest(s * (1 - sa), sa * (sc - s)) > 0 THEN (s - sa * sc) / greatest(s * (1 - sa), sa * (sc - s)) ELSE 0 END AS zhang FROM r WHERE s / sa >= 0.1 AND s / sa / sc >= 0.5)"""


def found_rules(t):
    return B.rules(itemsets(t), 0.1, 0.5)


@query("bsk9_rules", "BSK-9 BSK-10", f"WITH {_RULES} SELECT antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(leverage, 6) + 0.0 AS leverage, round(conviction, 6) AS conviction, round(zhang, 6) + 0.0 AS zhang FROM rules")
def _(t):
    out = _round(_joined(found_rules(t)), 6)
    return out.withColumns({"leverage": F.col("leverage") + 0.0, "zhang": F.col("zhang") + 0.0})


@query("bsk11_lift_bands", "BSK-11", f"WITH {_RULES} SELECT CASE WHEN lift >= 3 THEN 'strong' WHEN lift >= 1.5 THEN 'clear' WHEN lift >= 1.1 THEN 'weak' WHEN lift >= 0.9 THEN 'none' ELSE 'repelling' END AS band, count(*) AS n FROM rules GROUP BY 1")
def _(t):
    return found_rules(t).groupBy(B.lift_band(F.col("lift")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("bsk14_top_pairs", "BSK-14", f"WITH {_SETS} SELECT s AS items, n FROM sets WHERE len(string_split(s, ',')) = 2 ORDER BY n DESC, s LIMIT 10")
def _(t):
    sets = _joined(itemsets(t).where(F.size("items") == 2)).select("items", "n")
    return sets.orderBy(F.desc("n"), "items").limit(10)


@query("bsk15_network", "BSK-15", f"WITH {_RULES}, k AS (SELECT unnest(string_split(antecedent, ',')) AS node, support FROM rules UNION ALL SELECT unnest(string_split(consequent, ',')), support FROM rules) SELECT node, count(*) AS degree, round(max(support), 6) AS max_support FROM k GROUP BY 1")
def _(t):
    r = found_rules(t)
    ends = r.select(F.explode(F.concat("antecedent", "consequent")).alias("node"), "support")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.round(F.max("support"), 6).alias("max_support"))


@query("bsk16_set_sizes", "BSK-16", f"WITH {_SETS} SELECT len(string_split(s, ','))::BIGINT AS size, count(*) AS n FROM sets GROUP BY 1")
def _(t):
    return itemsets(t).groupBy(F.size("items").cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("bsk17_sensitivity", "BSK-17", f"WITH {_SETS} SELECT floor_::DOUBLE AS floor, count_if(support >= floor_) AS n FROM sets, (VALUES (0.05), (0.1), (0.2), (0.3), (0.5)) f(floor_) GROUP BY 1")
def _(t):
    floors = F.array(*[F.lit(f) for f in (0.05, 0.1, 0.2, 0.3, 0.5)])
    return itemsets(t).select("support", F.explode(floors).alias("floor")).groupBy("floor").agg(F.count_if(F.col("support") >= F.col("floor")).alias("n"))


@query("bsk13_completion", "BSK-13 JOIN-7", f"""WITH {_RULES}, hit AS (SELECT basket, items, lift, string_split(consequent, ',') AS c FROM b JOIN rules ON list_has_all(items, string_split(antecedent, ','))),
n AS (SELECT basket, lift, unnest(list_filter(c, lambda x: NOT list_contains(items, x))) AS item FROM hit), best AS (SELECT basket, item, max(lift) AS lift FROM n GROUP BY 1, 2)
SELECT basket, item, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY lift DESC, item) AS rn FROM best) WHERE rn <= 2""")
def _(t):
    rows = durable(baskets(t))
    return _round(B.completions(rows, B.rules(B.frequent_itemsets(rows, 0.05), 0.1, 0.5), 2), 6)


@query("bsk19_rule_search", "BSK-19 FLT-6", f"WITH {_RULES} SELECT antecedent, consequent, round(lift, 6) AS lift FROM rules WHERE list_contains(string_split(antecedent || ',' || consequent, ','), 'PROMO') AND lift >= 0.95")
def _(t):
    r = found_rules(t).where(F.array_contains(F.concat("antecedent", "consequent"), "PROMO") & (F.col("lift") >= 0.95))
    return _round(_joined(r.select("antecedent", "consequent", "lift")), 6)


_EARLY = _RULES.replace("WHERE l_quantity > 0 AND p_type IS NOT NULL", "JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 0 AND p_type IS NOT NULL AND o_orderdate < TIMESTAMP '1999-01-01'")


@query("bsk12_revalidation", "BSK-12 JOIN-8", f"""WITH {_EARLY}, lb AS (SELECT basket, list_sort(list(item)) AS items FROM (SELECT DISTINCT l_orderkey AS basket, upper(trim(p_type)) AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  WHERE l_quantity > 0 AND o_orderdate >= TIMESTAMP '1999-01-01') GROUP BY 1 HAVING count(*) >= 2),
x AS (SELECT antecedent, consequent, count_if(list_has_all(items, string_split(antecedent, ','))) AS na, count_if(list_has_all(items, string_split(consequent, ','))) AS nc, count_if(list_has_all(items, string_split(antecedent || ',' || consequent, ','))) AS late_n, count(*) AS t FROM rules, lb GROUP BY 1, 2)
SELECT antecedent, consequent, late_n, round(late_n * t::DOUBLE / (na * nc), 6) AS late_lift, CASE WHEN na = 0 OR nc = 0 THEN 'unmeasurable' WHEN late_n * t::DOUBLE / (na * nc) >= 0.95 THEN 'confirmed' ELSE 'degraded' END AS status FROM x""")
def _(t):
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    p = pairs(t).join(t.orders.select(F.col("o_orderkey").alias("basket"), (F.col("o_orderdate") < cut).alias("early")), "basket")
    p = durable(p)
    early, late = p.where("early").drop("early"), p.where("not early").drop("early")
    items = early.select("item").distinct()
    found = B.rules(B.frequent_itemsets(B.baskets(early, items), 0.05), 0.1, 0.5)
    out = B.remeasured(found, B.baskets(late, items), 0.95)
    return _round(_joined(out.select("antecedent", "consequent", "late_n", "late_lift", "status")), 6)
