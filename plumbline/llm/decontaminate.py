"""Benchmark decontamination by a hash set of word windows.  DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (the whole item if it has fewer).
Hashing every window of every document is not needed: a window of L words always covers one
whole block of a = (L + 1) // 2 words that starts at a multiple of L - a + 1, so only these
blocks are hashed, looked up among all a-word grams of the benchmark, and each hit is verified
word for word in the up to L - a + 1 windows around it.  Nothing is lost, and a seventh of the
hashes is made.  The benchmark's grams are broadcast while their size is within a bound;
beyond it the same join is shuffled on the hash.

Edge cases: null and empty texts have no words and no hits; items without a word are ignored;
repeated rows are judged each on its own; an item without an id counts in ``n_hit`` but cannot
be named; an empty benchmark leaves every document clean; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_BYTES, NO_WORD, by_shuffle, fresh, lower_ascii, pieces, quoted, small

WINDOW = 13


def _words(text: Column) -> Column:
    return pieces(lower_ascii(text), NO_WORD)


def _block(length: int) -> tuple[int, int]:
    """Words of a hashed block, and the distance between two of them."""
    a = (length + 1) // 2
    return a, length - a + 1


def benchmark_grams(benchmark: DataFrame, item: str, text: str, window: int = WINDOW) -> DataFrame:
    """(len, h, item, ctx, left): each gram's hash, and the item's words that windows over it use."""
    w = F.col("w")
    rows = benchmark.select(quoted(item).cast("string").alias("item"), _words(quoted(text)).alias("w"))
    rows = rows.where(F.size(w) > 0).withColumn("len", F.least(F.size(w), F.lit(window)))
    rows = rows.withColumn("a", F.floor((F.col("len") + 1) / 2).cast("int"))
    rows = rows.select("item", "len", "a", "w", F.explode(F.sequence(F.lit(1), F.size(w) - F.col("a") + 1)).alias("q"))
    left = F.least(F.col("q") - 1, F.col("len") - F.col("a"))
    return rows.select(
        "len", F.xxhash64(F.slice(w, F.col("q"), F.col("a"))).alias("h"), "item",
        F.slice(w, F.col("q") - left, left + F.col("len")).alias("ctx"), left.alias("left"),
    ).distinct()


def _blocks(w: Column, length: int) -> Column:
    """The hashed blocks of a document for windows of ``length`` words, each with the words around."""
    a, step = _block(length)
    side = length - a
    at = F.sequence(F.lit(1), F.size(w) - F.lit(a - 1), F.lit(step))

    def one(p: Column) -> Column:
        left = F.least(p - 1, F.lit(side))
        return F.struct(
            F.lit(length).alias("len"), F.xxhash64(F.slice(w, p, a)).alias("h"), p.alias("p"),
            F.slice(w, p - left, left + F.lit(length)).alias("dctx"), left.alias("dleft"),
        )

    return F.when(F.size(w) >= length, F.transform(at, one)).otherwise(F.array().cast(
        "array<struct<len:int,h:bigint,p:int,dctx:array<string>,dleft:int>>"))


def scan(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, n_words, spans, items, n_hit, contaminated.

    ``spans`` are (start, end) word positions, 0-based and end-exclusive, of the occurrences;
    ``items`` the ids, as strings in order, of the items that occur.  ``docs`` must be a table
    or another source that gives the same rows when read again.
    """
    grams = benchmark_grams(benchmark, item, item_text, window)
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # 1 to ``window``
    # As rows: each word of ctx has 16 bytes besides its own.  Spark knows the items' file only.
    room = F.octet_length(F.array_join("ctx", " ")) + 16 * F.size("ctx") + 100
    grams = F.broadcast(grams) if small(grams, room, broadcast_bytes) else by_shuffle(grams)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), quoted(doc_id).alias("id"),
        F.xxhash64(quoted(text)).alias("text_hash"), _words(quoted(text)).alias("w"),
    )
    # The block with a null hash keeps the row of a document without hits.
    none = F.array(F.struct(
        F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("p"),
        F.array().cast("array<string>").alias("dctx"), F.lit(0).alias("dleft"),
    ))
    found = rows.select(
        "row", "id", "text_hash", F.size("w").alias("n_words"),
        F.inline(F.concat(none, *[_blocks(F.col("w"), n) for n in lengths])),
    )
    found = found.join(grams, ["len", "h"], "left").where(F.col("ctx").isNotNull() | (F.col("len") == 0))

    def holds(k: Column) -> Column:
        """The window that begins k words before the block is the same in both."""
        mine = F.slice("dctx", F.col("dleft") + 1 - k, F.col("len"))
        theirs = F.slice("ctx", F.col("left") + 1 - k, F.col("len"))
        return (F.size(mine) == F.col("len")) & (mine == theirs)

    ks = F.filter(F.sequence(F.lit(0), F.least("dleft", "left")), holds)
    hits = F.transform(ks, lambda k: F.struct(
        (F.col("p") - 1 - k).alias("start"), (F.col("p") - 1 - k + F.col("len")).alias("end")))
    found = found.withColumn("hits", F.when(F.col("ctx").isNotNull(), hits))
    found = found.where((F.col("len") == 0) | (F.size("hits") > 0))
    per_doc = found.groupBy("row", "id", "text_hash", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    # The occurrences' union, from left to right.
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["upto"], x["end"]).alias("upto"),
            (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"]))).alias("n"),
        ), lambda s: s["n"],
    )
    per_doc = per_doc.select(
        "id", "text_hash", F.col("n_words").cast("bigint").alias("n_words"), "spans", "items", covered.alias("n_hit"))
    return per_doc.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options,
) -> DataFrame:
    """``docs`` without its contaminated rows, columns as they were."""
    hit = scan(docs, benchmark, doc_id, text, **options).where("contaminated").select("id", "text_hash").distinct()
    return docs.join(
        hit, quoted(doc_id).eqNullSafe(hit["id"]) & (F.xxhash64(quoted(text)) == hit["text_hash"]), "left_anti")


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "clean_text",
    **options,
) -> DataFrame:
    """``docs`` with ``out``: the text without the benchmark's passages; untouched texts stay as they are.

    What lies between two kept words stays; a removed passage takes the separators before its
    words along.  An existing column ``out`` is replaced.
    """
    hit = scan(docs, benchmark, doc_id, text, **options).where("n_hit > 0")
    hit = hit.select("id", "text_hash", "spans").dropDuplicates(["id", "text_hash"])
    spans, parts = fresh("spans", docs), fresh("parts", docs)
    hit = hit.withColumnRenamed("spans", spans)
    kept = [quoted(c) for c in docs.columns]
    joined = docs.join(
        hit, quoted(doc_id).eqNullSafe(hit["id"]) & (F.xxhash64(quoted(text)) == hit["text_hash"]), "left",
    ).select(*kept, quoted(spans))
    # Each part: separators, then one word; the tail after the last word is a part too.
    cut = F.regexp_extract_all(
        quoted(text), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(?:[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|\z)"), F.lit(0))
    gone = F.flatten(F.transform(quoted(spans), lambda s: F.sequence(s["start"], s["end"] - 1)))
    joined = joined.withColumn(parts, F.when(quoted(spans).isNotNull(), cut))
    left = F.filter(quoted(parts), lambda part, i: ~F.array_contains(gone, i))
    return joined.withColumn(
        out, F.when(quoted(spans).isNull(), quoted(text)).otherwise(F.array_join(left, ""))).drop(spans, parts)
