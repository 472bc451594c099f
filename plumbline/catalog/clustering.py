"""Choosing a clustering of the customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.outliers import points
from plumbline.catalog.registry import query
from plumbline.catalog.segmentation import _SCORES, rfm
from plumbline.operators import clusters as C
from plumbline.operators import segments as S
from plumbline.plans import ordering


def _rows(t):
    return points(t).select(F.col("customer").alias("id"), "x")


@query("seg4_k_sweep", "SEG-4")
def _(t):
    return C.k_sweep(_rows(t), range(2, 11))


@query("seg12_gap_statistic", "SEG-12 SMP-4")
def _(t):
    return C.gap_statistic(_rows(t), range(2, 9), replicates=6, restarts=2)


@query("seg13_stability", "SEG-13 SMP-3")
def _(t):
    return C.stability(_rows(t), 4)


@query("seg17_distinct_names", "SEG-17", f"""WITH {_SCORES}, v AS (SELECT r AS segment, rfm.monetary, rfm.frequency, rfm.recency FROM sc JOIN rfm USING (customer)),
p AS (SELECT segment, CASE WHEN segment >= 4 THEN 'active' ELSE 'quiet' END AS name, quantile_cont(monetary, 0.5) AS monetary, quantile_cont(frequency, 0.5) AS frequency, quantile_cont(recency, 0.5) AS recency FROM v GROUP BY 1),
s AS (SELECT *, count(*) OVER w AS n, (max(monetary) OVER w - min(monetary) OVER w) / greatest(min(monetary) OVER w, 1e-9) AS s1, (max(frequency) OVER w - min(frequency) OVER w) / greatest(min(frequency) OVER w, 1e-9) AS s2,
  (max(recency) OVER w - min(recency) OVER w) / greatest(min(recency) OVER w, 1e-9) AS s3 FROM p WINDOW w AS (PARTITION BY name)),
b AS (SELECT *, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 'monetary' WHEN s2 >= s3 THEN 'frequency' ELSE 'recency' END AS col FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE col WHEN 'monetary' THEN monetary WHEN 'frequency' THEN frequency ELSE recency END DESC, segment) AS r FROM b)
SELECT segment, CASE WHEN n = 1 THEN name WHEN n = 2 THEN name || ' (' || CASE r WHEN 1 THEN 'higher' ELSE 'lower' END || ' ' || col || ')' ELSE name || ' (tier ' || r || ' ' || col || ')' END AS name, CASE WHEN n > 1 THEN col END AS settled_by FROM r""")
def _(t):
    table = rfm(t)
    v = S.rfm_scores(table).select("customer", F.col("r").alias("segment")).join(table.select("customer", "monetary", "frequency", "recency"), "customer")
    out = v.select("segment").distinct().withColumn("name", F.when(F.col("segment") >= 4, "active").otherwise("quiet"))
    for c in ("monetary", "frequency", "recency"):
        out = out.join(ordering.quantile_columns(v, c, {c: 0.5}, ["segment"]), "segment")
    return C.distinct_names(out, "segment", "name", ["monetary", "frequency", "recency"]).select("segment", "name", "settled_by")
