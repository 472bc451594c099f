"""Whole profiles and reports of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.evaluation import _round
from plumbline.catalog.registry import query
from plumbline.catalog.trips import SCORED_SQL, scored
from plumbline.operators import reports as R


def _orders(t):
    return t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"))


_O = "o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority FROM orders)"


@query("prf9_missing_pairs", "PRF-9", f"""WITH {_O}, n AS (SELECT count(*) AS n FROM o) SELECT '*' AS a, '*' AS b, sum((status IS NULL)::BIGINT + (price IS NULL)::BIGINT + (priority IS NULL)::BIGINT)::BIGINT AS both, round(sum((status IS NULL)::BIGINT + (price IS NULL)::BIGINT + (priority IS NULL)::BIGINT) / (4 * count(*)), 6) AS share FROM o
UNION ALL SELECT '*', 'complete', count_if(status IS NOT NULL AND price IS NOT NULL AND priority IS NOT NULL), round(count_if(status IS NOT NULL AND price IS NOT NULL AND priority IS NOT NULL) / count(*), 6) FROM o
UNION ALL SELECT least(a, b), greatest(a, b), c, round(c / n, 6) FROM (SELECT 'price' AS a, 'priority' AS b, count_if(price IS NULL AND priority IS NULL) AS c FROM o UNION ALL SELECT 'price', 'status', count_if(price IS NULL AND status IS NULL) FROM o UNION ALL SELECT 'priority', 'status', count_if(priority IS NULL AND status IS NULL) FROM o), n WHERE c > 0""")
def _(t):
    return _round(R.missing_pairs(_orders(t)), 6).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "both", "share")


def _kinds(rows: str) -> str:
    return f"SELECT feature, kind, item, round(value, 6) + 0.0 AS value FROM ({rows})"


@query("prf10_class_target", "PRF-10", f"""WITH {SCORED_SQL}, c AS (SELECT 'segment' AS feature, segment AS item, avg(label) AS value FROM scored GROUP BY 2 UNION ALL SELECT 'region', region, avg(label) FROM scored GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value DESC, item) AS r FROM c),
m AS (SELECT 'price' AS feature, label::VARCHAR AS item, avg(price) AS value FROM scored GROUP BY 2 UNION ALL SELECT 'score', label::VARCHAR, avg(score) FROM scored GROUP BY 2)
{_kinds('''SELECT feature, 'numeric-by-class' AS kind, item, value FROM m UNION ALL SELECT feature, 'numeric-by-class', 'separation', max(value) - min(value) FROM m GROUP BY 1 UNION ALL SELECT feature, 'rate-by-category', item, value FROM r WHERE r <= 6 UNION ALL SELECT feature, 'rate-by-category', 'spread', max(value) - min(value) FROM c GROUP BY 1''')}""")
def _(t):
    out = R.target_association(scored(t), "label", ["price", "score", "segment", "region"], "id")
    return out.select("feature", "kind", "item", (F.round("value", 6) + 0.0).alias("value"))


@query("prf10_numeric_target", "PRF-10", f"""WITH {SCORED_SQL}, k AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS b FROM scored), c AS (SELECT 'segment' AS feature, segment AS item, avg(price) AS value FROM scored GROUP BY 2)
{_kinds('''SELECT 'score' AS feature, 'numeric-vs-numeric' AS kind, 'pearson' AS item, corr(price, score) AS value FROM scored UNION ALL SELECT 'score', 'numeric-vs-numeric', 'spearman', corr(a, b) FROM k UNION ALL SELECT feature, 'target-mean-by-category', item, value FROM c''')}""")
def _(t):
    out = R.target_association(scored(t), "price", ["score", "segment"], "id")
    return out.select("feature", "kind", "item", (F.round("value", 6) + 0.0).alias("value"))


@query("prf18_full_profile", "PRF-18")
def _(t):
    return R.full_profile(scored(t), "id", target="label", order="ts", rules={"price": "price > 0", "score": "score between 0 and 1"})


@query("cls11_report", "CLS-11")
def _(t):
    return R.classification_report(scored(t), "id", cost_fn=5.0)
