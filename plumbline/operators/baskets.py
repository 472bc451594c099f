"""Market-basket mining on (basket, item) rows; baskets stay small arrays, never a wide matrix."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import durable


def curated(lines: DataFrame, basket: str, item: str, quantity: str) -> DataFrame:
    """Distinct (basket, item) of lines with a positive quantity and an item; items trimmed, upper case."""
    return lines.where((F.col(quantity) > 0) & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.upper(F.trim(item)).alias("item")).distinct()


def vocabulary(pairs: DataFrame, top: int) -> DataFrame:
    """(item, n): the items in most baskets."""
    return pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(top)


def baskets(pairs: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """(basket, items): sorted items of the vocabulary, in baskets with at least ``least`` of them."""
    rows = pairs.join(items.select("item"), "item", "left_semi")
    return rows.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items")).where(F.size("items") >= least)


def kinds(rows: DataFrame, *more: Column) -> DataFrame:
    """(items, rows, basket) and ``more``: the distinct sets of items, how many rows have each, and a number for it; written."""
    same = rows.groupBy(F.array_sort(F.array_distinct("items")).alias("items")).agg(F.count(F.lit(1)).alias("rows"), *more)
    return durable(same.withColumn("basket", F.monotonically_increasing_id()))


def candidates(level: DataFrame) -> DataFrame:
    """(head, last): the sets one longer than those of ``level`` (s, sorted arrays) all of whose parts are in it."""
    cut = level.select("s", F.slice("s", 1, F.size("s") - 1).alias("stem"), F.element_at("s", -1).alias("end"))
    other = cut.select("stem", F.col("end").alias("last"))
    pairs = cut.join(other, "stem").where(F.col("end") < F.col("last")).select(F.col("s").alias("head"), "last")
    size = level.select(F.max(F.size("s"))).first()[0] or 0
    for i in range(1, size):  # leaving out the last or the one before gives the two sets that were joined
        without = F.concat(F.slice("head", 1, i - 1), F.slice("head", i + 1, size), F.array("last"))
        pairs = pairs.withColumn("s", without).join(level.select("s"), "s", "left_semi").drop("s")
    return pairs


def frequent_itemsets(rows: DataFrame, support: float, longest: int | None = 3) -> DataFrame:
    """(items, n, support), level by level; each level is written.  Without ``longest``, sets of any length.

    A set can be frequent only if all its parts are, so a level's candidates are made from the
    frequent sets of the one before, and a basket is looked at as rows (basket, set): what it has
    of a level is joined with the candidates that begin so, and then with its own items.  No set
    that is not a candidate is ever made in a basket, however long it is.  Baskets of the same items
    are looked at once, with their number.
    """
    rows = kinds(rows, F.count("basket").alias("named"))  # a null basket has items, but no pairs
    total = rows.agg(F.sum("rows")).first()[0] or 0
    least = support * total
    held = rows.select("basket", "rows", "named", F.explode("items").alias("item"))
    singles = durable(held.groupBy("item").agg(F.sum("rows").alias("n")).where(F.col("n") >= least))
    held = durable(held.join(singles.select("item"), "item", "left_semi").select("basket", "item", "named"))
    level = singles.select(F.array("item").alias("s"), "n")
    out, at = level, held.select("basket", F.array("item").alias("s"))
    for _ in range(1, longest) if longest else count():
        next_ = durable(candidates(level))
        if next_.isEmpty():
            break
        grown = at.join(next_, at["s"] == next_["head"]).select("basket", "head", F.col("last").alias("item"))
        at = durable(grown.join(held, ["basket", "item"]).select("basket", "named", F.concat("head", F.array("item")).alias("s")))
        level = durable(at.groupBy("s").agg(F.sum("named").alias("n")).where(F.col("n") >= least))
        out = out.unionByName(level)
        at = at.join(level.select("s"), "s", "left_semi").select("basket", "s")
    return out.select(F.col("s").alias("items"), "n", (F.col("n") / F.lit(max(1, total))).alias("support"))


def rules(itemsets: DataFrame, confidence: float = 0.25, lift: float = 1.2) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift, leverage, conviction, zhang): every split of every set."""
    items = F.col("items")
    # A subset for each number from 1 to 2 ** size - 2, whose bits say which items are in it.
    masks = F.sequence(F.lit(1).cast("bigint"), (F.pow(F.lit(2.0), F.size(items)) - 2).cast("bigint"))
    part = lambda m: F.filter(items, lambda x, i: F.getbit(m, i) == 1)
    split = itemsets.where(F.size("items") > 1).select("items", "support", F.explode(F.transform(masks, part)).alias("antecedent"))
    split = split.withColumn("consequent", F.array_except("items", "antecedent"))
    known = itemsets.select(F.col("items").alias("k"), F.col("support").alias("s"))
    both = split.join(known.withColumnsRenamed({"k": "antecedent", "s": "sa"}), "antecedent").join(known.withColumnsRenamed({"k": "consequent", "s": "sc"}), "consequent")
    s, a, c = F.col("support"), F.col("sa"), F.col("sc")
    conf = s / a
    out = both.select(
        "antecedent", "consequent", "support", conf.alias("confidence"), (conf / c).alias("lift"), (s - a * c).alias("leverage"),
        F.when(conf < 1, (1 - c) / (1 - conf)).alias("conviction"),
        F.when(F.greatest(s * (1 - a), a * (c - s)) > 0, (s - a * c) / F.greatest(s * (1 - a), a * (c - s))).otherwise(0.0).alias("zhang"))
    return out.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))


def lift_band(lift: Column) -> Column:
    return F.when(lift >= 3, "strong").when(lift >= 1.5, "clear").when(lift >= 1.1, "weak").when(lift >= 0.9, "none").otherwise("repelling")


def completions(rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(basket, item, lift): for each basket the k items that its best applicable rules add, by lift.

    A rule is reached by its first antecedent item, then the whole antecedent is checked.  Baskets of
    the same items are completed once.
    """
    whole = durable(rows.select("basket", "items", F.array_sort(F.array_distinct("items")).alias("kind")))
    rows = durable(whole.select(F.col("kind").alias("items")).distinct().withColumn("basket", F.monotonically_increasing_id()))
    by_item = rows.select("basket", "items", F.explode("items").alias("first"))
    keyed = found.select("antecedent", "consequent", "lift", F.element_at("antecedent", 1).alias("first"))
    hits = by_item.join(keyed, "first").where(F.size(F.array_except("antecedent", "items")) == 0)
    new = hits.select("basket", "lift", F.explode(F.array_except("consequent", "items")).alias("item"))
    best = new.groupBy("basket", "item").agg(F.max("lift").alias("lift"))
    top = best.groupBy("basket").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("lift")).alias("minus"), "item"))), 1, k).alias("t"))
    top = rows.join(top, "basket").select(F.col("items").alias("kind"), "t")
    own = whole.join(top, "kind").groupBy("basket").agg(F.array_sort(F.flatten(F.collect_set("t"))).alias("t"))
    # A basket that comes as several rows has the best of them.
    first = F.filter("t", lambda x, i: ~F.array_contains(F.slice(F.transform("t", lambda y: y["item"]), F.lit(1), i), x["item"]))
    own = own.select("basket", F.inline(F.slice(first, 1, k)))
    return own.select("basket", "item", (-F.col("minus")).alias("lift"))


def remeasured(found: DataFrame, late: DataFrame, least_lift: float) -> DataFrame:
    """``found`` with late_n, late_lift and status: confirmed, degraded, or unmeasurable without late baskets of a side.

    The late baskets are those of the vocabulary that the rules were mined with.
    """
    sides = found.select(F.col("antecedent").alias("s")).union(found.select("consequent")).union(found.select(F.array_sort(F.concat("antecedent", "consequent")))).distinct()
    late = kinds(late)
    first = late.select("items", "rows", F.explode("items").alias("first"))
    hits = first.join(sides.select("s", F.element_at("s", 1).alias("first")), "first").where(F.size(F.array_except("s", "items")) == 0)
    counts = hits.groupBy("s").agg(F.sum("rows").alias("n"))
    total = late.agg(F.sum("rows")).first()[0] or 0
    named = lambda column, n: counts.select(F.col("s").alias(column), F.col("n").alias(n))
    out = found.withColumn("whole", F.array_sort(F.concat("antecedent", "consequent")))
    out = out.join(named("antecedent", "na"), "antecedent", "left").join(named("consequent", "nc"), "consequent", "left").join(named("whole", "late_n"), "whole", "left").drop("whole")
    lift = F.coalesce("late_n", F.lit(0)) * F.lit(float(total)) / (F.col("na") * F.col("nc"))
    status = F.when(F.col("na").isNull() | F.col("nc").isNull(), "unmeasurable").when(lift >= least_lift, "confirmed").otherwise("degraded")
    return out.withColumns({"late_lift": lift, "status": status, "late_n": F.coalesce("late_n", F.lit(0))}).drop("na", "nc")
