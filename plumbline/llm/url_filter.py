"""URL filters by dated lists.  DataFrame functions only.

A list is a table of dated entries (category, domain, day, listed): from ``day`` on the domain
is listed, or no longer listed, in the category.  Entries become validity intervals, from an
entry to the next one of the same category and domain.  A capture (url, day) is blocked if, on
its day, its host or a parent domain of it is listed: the host's suffixes are equality-joined
with the intervals' domains and the day is compared, which is the as-of join.  A hot host's
captures are spread over salts, with a copy of the intervals for each; the intervals are
broadcast only while their size is within a bound.

Edge cases: null urls or days, and urls without a host, match nothing; hosts are compared in
lower case without user, port, a leading ``www.`` and a trailing dot; of several entries of one
category, domain and day, a listing one wins; repeated captures are judged each; an empty list
blocks nothing; other columns pass through, and columns of the result's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_BYTES, SALTS, fresh, quoted, small


def host_of(url: Column) -> Column:
    """The host in lower case, or null."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+?)\.?(?:[:/?#]|$)", 1)
    return F.when(found != "", found)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, down to two labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)),
        lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(category, domain, since, until) of each spell on a list; an open end is null."""
    days = entries.where(F.col("domain").isNotNull() & F.col("day").isNotNull()).groupBy(
        "category", F.lower("domain").alias("domain"), "day").agg(F.max("listed").alias("listed"))
    order = Window.partitionBy("category", "domain").orderBy("day")
    return days.withColumn("until", F.lead("day").over(order)).where("listed").select(
        "category", "domain", F.col("day").alias("since"), "until")


def match(
    captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``captures`` with host, categories (in order), matched_domain (the longest) and blocked.

    Needs no key: the distinct (host, day) pairs are judged, and joined back.
    """
    host, on = fresh("__host", captures), fresh("__day", captures)
    rows = captures.withColumns({host: host_of(quoted(url)), on: quoted(day)})
    pairs = rows.select(F.col(host).alias("h"), F.col(on).alias("d")).where("h is not null and d is not null").distinct()
    spells = intervals(entries)
    spells_small = small(spells, F.octet_length("domain") + 60, broadcast_bytes)
    cut = pairs.select("h", "d", F.explode(suffixes(F.col("h"))).alias("domain"))
    holds = (F.col("d") >= F.col("since")) & (F.col("until").isNull() | (F.col("d") < F.col("until")))
    if spells_small:
        found = cut.join(F.broadcast(spells), "domain").where(holds)
    else:
        salted = spells.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        cut = cut.withColumn("salt", F.pmod(F.xxhash64("h", "d"), F.lit(SALTS)).cast("int"))
        found = cut.join(salted, ["domain", "salt"]).where(holds)
    hits = found.groupBy("h", "d").agg(
        F.array_sort(F.collect_set("category")).alias("c"), F.max(F.struct(F.length("domain"), "domain"))["domain"].alias("m"))
    salt = fresh("__salt", captures)
    hits = hits.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(quoted(url), F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    names = ("host", "categories", "matched_domain", "blocked")
    h = hits.alias("h")
    joined = rows.alias("r").join(
        h, (F.col(f"r.{host}") == F.col("h.h")) & (F.col(f"r.{on}") == F.col("h.d")) & (F.col(f"r.{salt}") == F.col(f"h.{salt}")), "left")
    return joined.select(
        *[F.col("r.`" + c.replace("`", "``") + "`") for c in captures.columns if c.lower() not in names], F.col(f"r.{host}").alias("host"),
        F.coalesce("h.c", F.array().cast("array<string>")).alias("categories"), F.col("h.m").alias("matched_domain"),
        F.col("h.m").isNotNull().alias("blocked"))
