"""Near copies by exact Jaccard similarity of word shingles, with SimHash groups and min-hash bands for candidates.

Two texts are near copies if the sets of their shingles of ``shingle`` words have a Jaccard
similarity of at least ``least``; the components of these links are the groups.  Words are as in
``simhash_dedup``.

Texts with equal sets are one node, so copies are never paired.  Each text has its fingerprint of
``simhash_dedup``, and the group that the links of that method make is a key of its node.  Its two
bits are close to identity, so a node has BANDS more keys, of ROWS min-hashes each.  Nodes with a
key in common are candidates, and each candidate pair is verified on its whole sets.  A link is
therefore never wrong, but it can be missed: a pair of similarity s that SimHash does not group has
a key in common with probability 1 - (1 - s ** ROWS) ** BANDS, which is 0.998 at 0.8.

Of keys that up to ``bucket`` nodes share all pairs are candidates.  Under a larger key, which a
family of many variants of one text makes, each node is first held against REPRESENTATIVES nodes of
it: half are those whose keys have most nodes in all, which is the text that a family's variants
were made from, or the most central of them; half are the least by as many hash orders.  Both are
much the same for all keys of a family, so a group meets the same few everywhere.  That links most
of a family.  What is left open are nodes of one key in different components by then: those
outside the key's largest component are compared with all of the key's nodes, block by block, inside
the task.  First by their min-hashes, a byte each: a pair goes on if it agrees as often as a
similarity of ``least`` allows (four standard deviations below its mean: of pairs at 0.8 one in
20,000 is under it).  Then, if both have up to SET_BOUND shingles, by their whole sets, and of the
links found the task gives only those that join components; pairs with a longer text are handed on
and verified like all others.  So nothing is capped, a family that is one component costs rows in
proportion to its size, and one that is not costs its square in comparisons, but not in rows.

Edge cases: texts without a word, null included, are one group; a text with fewer words than a
shingle is one shingle; repeated rows share their group; a group without any id keeps one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import simhash_dedup
from plumbline.llm.common import BROADCAST_BYTES, by_shuffle, quoted, small, stored
from plumbline.llm.simhash_dedup import SEED, components, keep_one, named, shingle_hashes

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 20, 6
#: Nodes of one key that are still paired, what larger keys are held against first, and nodes of a block of the rest.
BUCKET, REPRESENTATIVES, BLOCK = 32, 8, 64
#: Shingles of a text whose whole set goes along with its block.
SET_BOUND = 512
#: How many standard deviations below its mean the agreement of two sketches may be.
DEVIATIONS = 4
#: What a node that is asked for takes of the driver and each executor when all of them are broadcast.
ASKED_BYTES = 64
#: Rows whose sets a Python worker holds at a time.
BATCH = 256
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS min-hashes of a set of shingle hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1 << 10):
        part = shingles[i : i + (1 << 10)]
        np.minimum(least, (_TIMES[:, None] * part + _PLUS[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """BANDS keys of min-hashes, as signed longs."""
    import xxhash

    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp, keys, sketch, shingles, print): one row per row; fp is a hash of the set of shingles, a sketch has a byte of each min-hash, print is the SimHash."""
    rows = docs.select(quoted(doc_id).alias("id"), F.xxhash64(quoted(text)).alias("text_hash"), quoted(text).alias("t"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        rows.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType()),
        T.StructField("keys", longs), T.StructField("sketch", T.BinaryType()), T.StructField("shingles", longs), T.StructField("print", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                texts = b.column(2).to_pylist()
                sets = [np.unique(shingle_hashes(x, shingle)) for x in texts]
                prints = np.array([simhash_dedup.fingerprint(x) for x in texts], np.uint64).view(np.int64)
                fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                least = [min_hashes(s) for s in sets]
                keys = [band_keys(x) if len(s) else [] for s, x in zip(sets, least)]  # the empty set has no key
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), pa.array(fp), pa.array(keys, pa.list_(pa.int64())),
                    pa.array([(x >> np.uint64(56)).astype(np.uint8).tobytes() for x in least], pa.binary()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(prints)], names=schema.names)

    return rows.mapInArrow(run, schema)


def print_groups(marks: DataFrame) -> DataFrame:
    """(fp, key): the nodes under the groups that ``simhash_dedup`` makes of their texts' fingerprints."""
    prints = by_shuffle(stored(marks.select("fp", "print").distinct(), "near-prints"))
    roots = stored(components(simhash_dedup.links(prints.select(F.col("print").alias("fp")).distinct())), "near-print-roots")
    found = prints.join(roots, prints["print"] == roots["node"], "left").select("fp", F.coalesce("root", "print").alias("root"))
    return found.select("fp", F.xxhash64("root", F.lit("print")).alias("key")).distinct()  # no band's key


def keyed(nodes: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(key, fp, n, size): nodes (fp, n, keys) under the keys, ``groups`` (fp, key) included, that more than one has; size is the key's."""
    rows = nodes.select("fp", "n", F.explode("keys").alias("key"))
    if groups is not None:
        rows = rows.unionByName(by_shuffle(nodes).where("n > 0").select("fp", "n").join(groups, "fp"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return by_shuffle(stored(by_shuffle(rows).join(shared, "key"), "near-members"))  # a row for each key


def candidates(members: DataFrame, least: float = LEAST, bucket: int = BUCKET) -> DataFrame:
    """(u, v), u > v: all pairs of small keys, and each node of a large one with its representatives.

    Pairs whose sizes n rule the similarity out are left out.
    """
    few, many = members.where(F.col("size") <= bucket), members.where(F.col("size") > bucket)
    pairs = few.select("key", "fp", "n").join(few.select("key", F.col("fp").alias("fp2"), F.col("n").alias("n2")), "key").where("fp > fp2")
    half = REPRESENTATIVES // 2
    wide = stored(many.groupBy("fp").agg(F.sum("size").alias("wide")), "near-wide")
    central = many.join(wide, "fp").select("key", "fp", "n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("wide"), "fp")).alias("place"))
    central = central.where(F.col("place") <= half).select("key", F.col("fp").alias("fp2"), F.col("n").alias("n2"))
    others = many.groupBy("key").agg(F.array(*[F.min(F.struct(F.xxhash64("fp", F.lit(i)).alias("o"), "fp", "n")) for i in range(half)]).alias("x"))
    others = others.select("key", F.explode(F.transform("x", lambda x: F.struct(x["fp"], x["n"]))).alias("x")).select("key", F.col("x.fp").alias("fp2"), F.col("x.n").alias("n2"))
    firsts = stored(central.unionByName(others).distinct(), "near-firsts")
    stars = many.join(firsts, "key").where("fp != fp2")
    both = pairs.select("fp", "n", "fp2", "n2").unionByName(stars.select("fp", "n", "fp2", "n2")).where(F.least("n", "n2") >= least * F.greatest("n", "n2"))
    return both.select(F.greatest("fp", "fp2").alias("u"), F.least("fp", "fp2").alias("v")).distinct()


def _sets_in_common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``one`` with each of ``two``."""
    shared = np.intersect1d(np.concatenate(one), np.concatenate(two))
    if not len(shared):
        return np.zeros((len(one), len(two)))
    marks = []
    for sets in (one, two):
        m = np.zeros((len(sets), len(shared)), np.float32)
        for i, x in enumerate(sets):
            at = np.searchsorted(shared, x)
            m[i, at[shared[np.minimum(at, len(shared) - 1)] == x]] = 1
        marks.append(m)
    return marks[0] @ marks[1].T


def left_open(marks: DataFrame, members: DataFrame, nodes: DataFrame, found: DataFrame, least: float = LEAST, bucket: int = BUCKET, block: int = BLOCK, set_bound: int = SET_BOUND) -> DataFrame:
    """(u, v, sure), u > v, of large keys: links between different components of ``found``, and pairs that may be such (not sure)."""
    many = members.where(F.col("size") > bucket).select("key", "fp")
    roots = stored(components(found), "near-roots-so-far")
    many = many.join(roots, many["fp"] == roots["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    groups = many.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    # A row for each key that still has several components.
    keys = groups.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("n_roots")).where("n_roots > 1")
    rows = by_shuffle(stored(by_shuffle(many).join(stored(keys.select("key", "main", "c"), "near-open-keys"), "key"), "near-open-members"))
    asked = rows.select("fp").distinct()
    sets = marks.where(F.size("shingles") <= set_bound).select("fp", "shingles").join(asked, "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"))
    facts = stored(by_shuffle(nodes).select("fp", "n", "sketch").join(asked, "fp", "left_semi").join(by_shuffle(sets), "fp", "left"), "near-open-nodes")
    part = F.pmod(F.xxhash64("fp"), F.ceil(F.col("c") / block))
    blocks = rows.join(by_shuffle(facts), "fp").groupBy("key", (F.col("root") != F.col("main")).alias("minor"), part.alias("part")).agg(F.collect_list(F.struct("fp", "root", "n", "sketch", "shingles")).alias("m"))
    blocks = by_shuffle(stored(blocks, "near-open-blocks"))  # their lists pack well
    one = blocks.where("minor").select("key", "part", F.col("m").alias("a"))
    two = blocks.select("key", F.col("part").alias("part2"), "minor", F.col("m").alias("b"))
    asked = one.join(two, "key").where("NOT minor OR part <= part2").select("a", "b")
    width = BANDS * ROWS
    bound = width * least - DEVIATIONS * (width * least * (1 - least)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpacked(cell):
            rows_ = cell.as_py()
            sets = [np.array(r["shingles"] or [], np.int64) for r in rows_]
            whole = np.array([r["shingles"] is not None for r in rows_])
            return [np.array([r[c] for r in rows_]) for c in ("fp", "root", "n")] + [np.frombuffer(b"".join(r["sketch"] for r in rows_), np.uint8).reshape(-1, width), sets, whole]

        def under(up: dict, x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for x, y in zip(batch.column(0), batch.column(1)):
                (fp, root, n, sketch, sets, whole), (fp2, root2, n2, sketch2, sets2, whole2) = unpacked(x), unpacked(y)
                may = (root[:, None] != root2) & (np.minimum(n[:, None], n2) >= least * np.maximum(n[:, None], n2))
                may &= np.stack([(sketch2 == row).sum(axis=1) for row in sketch]) >= bound
                both = whole[:, None] & whole2
                out += [(fp[i], fp2[j], False) for i, j in np.argwhere(may & ~both)]
                if (may & both).any():
                    common = _sets_in_common(sets, sets2)
                    up: dict = {}  # components that this pair of blocks has joined
                    for i, j in np.argwhere(may & both & (common >= least * (n[:, None] + n2 - common))):
                        r, r2 = under(up, root[i]), under(up, root2[j])
                        if r != r2:
                            up[max(r, r2)] = min(r, r2)
                            out.append((fp[i], fp2[j], True))
            yield pa.RecordBatch.from_arrays([
                pa.array([max(u, v) for u, v, _ in out], pa.int64()), pa.array([min(u, v) for u, v, _ in out], pa.int64()), pa.array([x for _, _, x in out], pa.bool_())], names=["u", "v", "sure"])

    return asked.mapInArrow(run, "u bigint, v bigint, sure boolean").distinct()


def verified(marks: DataFrame, pairs: DataFrame, least: float = LEAST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(u, v): the pairs of nodes that are similar enough, by their whole sets."""
    pairs = by_shuffle(stored(pairs, "near-candidates"))
    asked = stored(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "near-asked")
    if small(asked, F.lit(ASKED_BYTES), broadcast_bytes):
        sets = marks.select("fp", "shingles").join(F.broadcast(asked), "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("s"))
    else:
        sets = marks.groupBy("fp").agg(F.first("shingles").alias("s")).join(by_shuffle(asked), "fp", "left_semi")
    sets = by_shuffle(stored(sets, "near-sets"))
    one, two = sets.select(F.col("fp").alias("u"), F.col("s").alias("a")), sets.select(F.col("fp").alias("v"), F.col("s").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    found = pairs.join(two, "v").join(one, "u").select("u", "v", both.alias("both"), (F.size("a") + F.size("b")).alias("sum"))
    return stored(found.where(F.col("both") >= least * (F.col("sum") - F.col("both"))).select("u", "v"), "near-links")


def links(marks: DataFrame, least: float = LEAST, bucket: int = BUCKET, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(u, v), u > v: links between the nodes of ``marks``, enough for the components."""
    nodes = marks.groupBy("fp").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first(F.size("shingles")).alias("n"))
    nodes = stored(nodes, "near-nodes")
    members = keyed(nodes, print_groups(marks))
    found = verified(marks, candidates(members, least, bucket), least, broadcast_bytes)
    if members.where(F.col("size") > bucket).isEmpty():
        return found
    more = stored(left_open(marks, members, nodes, found, least, bucket), "near-open")
    found = found.unionByName(more.where("sure").select("u", "v"))
    unsure = more.where("NOT sure").select("u", "v")
    return found if unsure.isEmpty() else found.unionByName(verified(marks, unsure, least, broadcast_bytes))


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST, bucket: int = BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, root, component_id (the least id of the group)."""
    marks = stored(marked(docs, doc_id, text, shingle), "near-marks")
    return named(marks.select("id", "text_hash", "fp"), links(marks, least, bucket)).select("id", "text_hash", "root", "component_id")


def drop_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST, bucket: int = BUCKET,
) -> DataFrame:
    """``docs`` with one document of each group, that of the least id, as ``drop_near_duplicates``."""
    found = near_copies(docs, doc_id, text, shingle, least, bucket)
    return keep_one(docs, found.withColumn("g", F.col("root")), doc_id, text)
