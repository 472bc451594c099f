"""Line deduplication by site-relative frequency.  DataFrame functions only.

Pages are grouped by host.  For every line, the number of the host's pages that contain it is
divided by the host's pages; lines above ``ratio``, on ``least_pages`` pages or more, are boilerplate
and are dropped.  Counting
is by (host, line hash), so a hot host spreads over all tasks and a common line is summed
before the shuffle.  A host has at most (mean distinct lines per page) / ratio boilerplate
lines, so its list stays short; the lists are broadcast while their size is within a bound
and joined by (host, salt) beyond it.

Edge cases: lines are compared as they are, by a 64-bit hash; lines without a character other
than white space are never boilerplate; hosts with fewer than ``min_pages`` pages are left
alone; null hosts form one host; a null text stays null and counts as a page without lines; a page of
nothing but boilerplate loses all of it, or with ``keep_copied`` stays whole (for callers whose
near-duplicate removal judges copied pages); repeated rows count each; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_BYTES, SALTS, fresh, quoted, small, stored

RATIO = 0.1
MIN_PAGES = 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_text(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    least_pages: int = 1,
) -> DataFrame:
    """(host, line_hash, pages, host_pages) of every boilerplate line."""
    page = pages.select(quoted(host).alias("host"), F.coalesce(quoted(text), F.lit("")).alias("t"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("t")), _has_text), lambda x: F.xxhash64(x)))
    each = page.select("host", F.explode(hashes).alias("line_hash"))
    least = max(1, least_pages, int(min_pages * ratio))  # a line on fewer pages is under the ratio on every judged host
    counts = each.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("pages"))
    counts = counts.where(F.col("pages") >= least).withColumn("salt", F.pmod("line_hash", F.lit(SALTS)).cast("int"))
    totals = page.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).where(F.col("host_pages") >= min_pages)
    totals = totals.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    both = counts.alias("c").join(
        totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")) & (F.col("c.salt") == F.col("t.salt")))
    return both.where(F.col("pages") > ratio * F.col("host_pages")).select("c.host", "line_hash", "pages", "host_pages")


def drop_lines(
    pages: DataFrame, host: str = "source", text: str = "text", out: str = "text", ratio: float = RATIO,
    min_pages: int = MIN_PAGES, counts: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
    least_pages: int = 1, keep_copied: bool = False,
) -> DataFrame:
    """``pages`` with ``out``: the text without its host's boilerplate lines.

    With ``counts``, columns n_lines and n_dropped are added.  Columns of these names that
    ``pages`` already has are replaced.
    """
    lines = stored(boilerplate(pages, host, text, ratio, min_pages, least_pages), "boilerplate")
    h, salt, drop, split, kept = (fresh(f"__{n}", pages) for n in ("host", "salt", "drop", "lines", "kept"))
    lists = lines.groupBy(F.col("host").alias(h)).agg(F.collect_list("line_hash").alias(drop))
    if small(lines, F.lit(16), broadcast_bytes):
        joined = pages.join(F.broadcast(lists), quoted(host).eqNullSafe(quoted(h)), "left").drop(h)
    else:
        lists = lists.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        salted = pages.withColumn(salt, F.pmod(F.xxhash64(quoted(text)), F.lit(SALTS)).cast("int"))
        on = salted[salt].eqNullSafe(lists[salt]) & quoted(host).eqNullSafe(lists[h])
        joined = salted.join(lists, on, "left").drop(lists[salt]).drop(salt, h)
    joined = joined.withColumn(split, _lines(quoted(text)))
    hit = F.arrays_overlap(F.transform(quoted(split), lambda x: F.xxhash64(x)), quoted(drop))
    left = F.filter(quoted(split), lambda x: ~F.array_contains(quoted(drop), F.xxhash64(x)))
    joined = joined.withColumn(kept, F.when(F.coalesce(hit, F.lit(False)), left))
    if keep_copied:  # a page of nothing but boilerplate is a copy of a page
        joined = joined.withColumn(kept, F.when(F.exists(quoted(kept), _has_text), quoted(kept)))
    if counts:
        n = F.coalesce(F.size(quoted(split)), F.lit(0))
        joined = joined.withColumns({
            "n_lines": F.when(quoted(text).isNull(), 0).otherwise(n).cast("bigint"),
            "n_dropped": F.when(quoted(kept).isNull(), 0).otherwise(n - F.size(quoted(kept))).cast("bigint"),
        })
    cleaned = F.when(quoted(kept).isNull(), quoted(text)).otherwise(F.array_join(quoted(kept), "\n"))
    return joined.withColumn(out, cleaned).drop(split, drop, kept)
