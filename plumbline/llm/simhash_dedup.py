"""Near-duplicates by SimHash and deletion-variant signatures.

A text's fingerprint has a bit set if over half of its shingles' hashes have it.  Fingerprints
that differ in at most two of 64 bits are linked, and the components of the links are the groups.

The 64 bits are cut into only two segments, A and B.  Of two linked fingerprints one segment
then differs by at most one bit: either A is the same, or B is, or both differ in one bit.  So
every distinct fingerprint is indexed under A, under B, and under the 32 variants of A with one
bit deleted; equal entries are joined, and a pair is verified by counting the bits of its
exclusive or.  A pair is accepted only from the entry that is its own case, so it comes once.

Entries that more than ``bucket`` fingerprints share are not paired.  They are cut finer, by the
same method and just as exactly: inside an entry, the rest of the fingerprint may differ by two
bits (one for the variants of A), so each member is listed under all variants of the rest with
so many bits deleted, and those under one finer entry differ only there, so that each is linked
to the least.  That makes a fixed number of rows for each member and no pairs, however large the
entry.  Both ways find the same groups.

Components come from the alternation of large-star and small-star steps on written tables; no
link or component is ever on the driver, and no table that has a row for each entry, fingerprint
or document is broadcast.  Copies share a fingerprint and are never paired.

Edge cases: a null or empty text, or one without a word, has fingerprint zero and is linked like
any other; a text with fewer words than a shingle is one shingle; repeated rows share their
group; a null id never names a group, and a group without any id has component null; other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import by_shuffle, fresh, quoted, stored

SHINGLE = 3
MAX_BITS = 2
SEGMENT = 32
#: Fingerprints of one entry that are still paired; entries with more are cut finer.
BUCKET = 256
SEED = 42
_LOW = (1 << SEGMENT) - 1


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text: A-Z lower-cased, words between ASCII white space."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII splits
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp): one row per row; fp is the fingerprint's bits as a signed long."""
    rows = docs.select(quoted(doc_id).alias("id"), F.xxhash64(quoted(text)).alias("text_hash"), quoted(text).alias("t"))
    schema = T.StructType([rows.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["id", "text_hash", "fp"])

    return rows.mapInArrow(run, schema)


def _masks(bits: int, width: int) -> Column:
    """Masks of ``width`` low bits with ``bits`` of them deleted, as an array of longs."""
    full = (1 << width) - 1
    if bits == 1:
        out = [full ^ (1 << i) for i in range(width)]
    else:
        out = [full ^ (1 << i) ^ (1 << j) for i in range(width) for j in range(i)]
    return F.array(*[F.lit(m).cast("bigint") for m in out])


def entries(fps: DataFrame) -> DataFrame:
    """(kind, key, fp): a row per index entry; kind -1 is A, -2 is B, 0 to 31 A without that bit."""
    a, b = F.shiftrightunsigned("fp", SEGMENT), F.col("fp").bitwiseAND(F.lit(_LOW))
    variants = F.transform(
        _masks(1, SEGMENT), lambda m, i: F.struct(i.cast("int").alias("kind"), a.bitwiseAND(m).alias("key")))
    exact = F.array(F.struct(F.lit(-1).alias("kind"), a.alias("key")), F.struct(F.lit(-2).alias("kind"), b.alias("key")))
    return fps.select("fp", F.inline(F.concat(exact, variants))).select("kind", "key", "fp")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints (column fp), enough for the components.

    Entries of up to ``bucket`` members give every link of their case.
    """
    rows = entries(fps)
    shared = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # ``rows`` has 34 rows for each of ``fps``, which Spark takes for one.
    members = by_shuffle(stored(by_shuffle(rows).join(shared, ["kind", "key"]), "simhash-members"))
    few, many = members.where(F.col("n") <= bucket), members.where(F.col("n") > bucket)
    x, y = few.alias("x"), few.select("kind", "key", F.col("fp").alias("fp2")).alias("y")
    different = F.col("fp").bitwiseXOR(F.col("fp2"))
    own = (F.col("kind") < 0) | (F.shiftrightunsigned(different, SEGMENT) == F.expr("shiftleft(1L, kind)"))
    pairs = x.join(y, ["kind", "key"]).where((F.col("fp") > F.col("fp2")) & (F.bit_count(different) <= MAX_BITS) & own)
    pairs = pairs.select(F.col("fp").alias("u"), F.col("fp2").alias("v"))
    rest = F.when(F.col("kind") == -2, F.shiftrightunsigned("fp", SEGMENT)).otherwise(F.col("fp").bitwiseAND(F.lit(_LOW)))
    masks = F.when(F.col("kind") < 0, _masks(2, SEGMENT)).otherwise(_masks(1, SEGMENT))
    finer = many.select("kind", "key", "fp", F.posexplode(F.transform(masks, lambda m: rest.bitwiseAND(m))).alias("which", "fine"))
    # A finer entry's members differ in the deleted bits only: eight of them at most.
    finer = finer.groupBy("kind", "key", "which", "fine").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)
    stars = finer.select(F.explode("m").alias("u"), F.array_min("m").alias("v")).where("u > v")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node of its component."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # Stars that point to roots do not change any more: as many edges, and the same sum.
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def named(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """``marks`` (id, fp and others) with root and component_id by the links between their fp."""
    nodes = by_shuffle(stored(marks.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprint-reps"))
    roots = stored(components(edges), "simhash-roots")
    found = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    found = by_shuffle(stored(found, "simhash-named"))
    least = stored(found.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-least")
    by_fp = stored(found.join(least, "root").select("fp", "root", "component_id"), "simhash-by-fp")
    return marks.join(by_shuffle(by_fp), "fp")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, fp, fingerprint (16 hex digits), component_id.

    ``component_id`` is the least id of the documents reachable by links, itself included.
    """
    marks = stored(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    edges = links(stored(marks.select("fp").distinct(), "fingerprint-nodes"), bucket)
    return named(marks, edges).select("id", "text_hash", "fp", digits.alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET,
) -> DataFrame:
    """``docs`` with one document of each group, that of the least id; columns as they were.

    Of repeated rows with that id, in that group, one stays, the one with the least text hash.  A
    group without any id keeps one row.
    """
    found = near_duplicates(docs, doc_id, text, shingle, bucket)
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("?"), F.col("fingerprint")))
    return keep_one(docs, found.withColumn("g", group), doc_id, text)


def keep_one(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One document of each group g of ``found`` (id, text_hash, g)."""
    best = found.groupBy("g").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("text_hash"))).alias("k"))
    best = best.select(F.col("k.id").alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    same = found.groupBy(F.col("id").alias("s_id"), F.col("text_hash").alias("s_hash")).agg(F.count(F.lit(1)).alias("n"))
    rows = fresh("__rows", docs)
    best = by_shuffle(best).join(same, F.col("k_id").eqNullSafe(F.col("s_id")) & (F.col("k_hash") == F.col("s_hash"))).select(
        "k_id", "k_hash", F.col("n").alias(rows))
    on = quoted(doc_id).eqNullSafe(F.col("k_id")) & (F.xxhash64(quoted(text)) == F.col("k_hash"))
    kept = docs.join(by_shuffle(stored(best, "simhash-best")), on).drop("k_id", "k_hash")
    once = kept.where(quoted(rows) == 1).drop(rows)
    repeated = kept.where(quoted(rows) > 1).drop(rows)
    return once.unionByName(repeated.dropDuplicates([doc_id, text]))
