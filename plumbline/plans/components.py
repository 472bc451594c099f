"""Connected components of a table of links, by rounds of joins over written tables.

A round hangs every label under the least one that it is linked to, and follows what hangs under
what to the end, doubling the step each time, so that a chain of any length is one label after one
round.  Links whose ends have the same label are dropped, so later rounds move less.  A node with many links only ever
meets a minimum, which is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``links``; label is the least node of its component.

    Nulls at either end are left out; a link of a node with itself makes a component of one.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    labels = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    pairs = durable(pairs.where("a != b").distinct())
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("root"), "low")
        # Pairs are between labels: each label that is not the least around goes under the least.
        hung = durable(least.select("root", F.least("root", "low").alias("to")))
        while True:
            up = hung.select(F.col("root").alias("to"), F.col("to").alias("over"))
            hung = durable(hung.join(up, "to", "left").select("root", F.coalesce("over", "to").alias("to"), (F.col("over") < F.col("to")).alias("moved")))
            if hung.where("moved").isEmpty():
                break
            hung = hung.drop("moved")
        labels = durable(labels.join(hung, labels["label"] == hung["root"], "left").select("node", F.coalesce("to", "label").alias("label")))
        left = hung.select(F.col("root").alias("a"), F.col("to").alias("a2"))
        right = hung.select(F.col("root").alias("b"), F.col("to").alias("b2"))
        moved = pairs.join(left, "a").join(right, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        pairs = durable(moved.where("a != b").distinct())
    return labels
