"""A Merkle manifest of a table, with proofs from one multiproof for each block of leaves.

Every row is a leaf: the SHA-256 of its fields, each ``-`` if null, else its UTF-8 byte count, a
colon and its value.  Leaves ascend by id (then by leaf) within their group; every ARITY consecutive
nodes become their parent, the SHA-256 of their hexadecimal digests, until one is left.  The groups'
roots, ordered by the group's UTF-8 bytes with null first, are the leaves of a tree on top.

A node has the coordinates (tree, level, idx).  Leaves are dealt into blocks of ARITY ** HEIGHT
consecutive ones, so a group of any size, also one with most of the rows, is many tasks of bounded
size.  ``build`` hashes a block's subtree in one task and goes on with the blocks' roots, so two or
three rounds do for any table.  ``prove`` treats the rows asked for of one block together: from
their positions alone it lists the nodes that are neither theirs nor above them, each once for all
of them (``missing``), which come by one join; then it derives every shared interior once, from the
bottom up, and expands each row's own proof from the parts that rows have in common, top down.

Edge cases: null fields are ``-``, an empty text is ``0:``; repeated rows are leaves next to each
other, each with its own proof; a single leaf is its group's root; null ids come first; an empty
table has no nodes, and its root is None; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import quoted, stored
from plumbline.plans.ordering import row_numbers

ARITY = 8
#: Levels of a block: it holds up to ARITY ** HEIGHT leaves.
HEIGHT = 4
#: The tree over the groups' roots; groups' own names begin with one of the others, in this order.
TOP, NULL, NAMED = "", "-", "="
_NODE = T.StructType([
    T.StructField("tree", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("idx", T.LongType()), T.StructField("digest", T.StringType())])


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields."""
    parts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def height(n: int) -> int:
    """The level of the root over ``n`` leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // ARITY), level + 1
    return level


def _parent(children: Sequence[bytes]) -> bytes:
    return sha256(b"".join(children)).hexdigest().encode()


def missing(asked: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(level, positions) of the nodes that the leaves ``asked`` (sorted, distinct) of ``n`` need besides themselves."""
    out, level = [], 0
    while n > 1:
        above = np.unique(asked // ARITY)
        children = (above[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append((level, np.setdiff1d(children[children < n], asked, assume_unique=True)))
        asked, n, level = above, -(-n // ARITY), level + 1
    return out


def expand(known: list[dict[int, bytes]], n: int) -> tuple[list[dict[int, tuple[bytes, bytes]]], bytes]:
    """For each level, what stands left and right of each known node among its siblings; and the root.

    ``known`` has the digests by level and position that were asked for or fetched; their parents
    are added to it.
    """
    beside: list[dict[int, tuple[bytes, bytes]]] = []
    for level in range(height(n)):
        here, above, sides = known[level], known[level + 1], {}
        for parent in sorted({i // ARITY for i in here}):
            first = parent * ARITY
            places = range(first, min(first + ARITY, n))
            if not all(i in here for i in places):
                continue  # fetched for its own parent's sake only
            run = [here[i] for i in places]
            above[parent] = _parent(run)
            for i in places:
                sides[i] = (b"".join(run[: i - first]), b"".join(run[i - first + 1 :]))
        beside.append(sides)
        n = -(-n // ARITY)
    return beside, known[len(beside)][0]


@dataclass
class Manifest:
    """Leaves (tree, idx, id, digest, changed), nodes of all levels, (tree, n, subroot, rank) and the root."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_trees: int
    root: str | None


def _interiors(base: DataFrame, levels: int) -> DataFrame:
    """All nodes above ``base`` (tree, level, idx, digest), which is one whole level of each of its trees."""
    size, found = ARITY ** levels, []

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table["idx"]), kind="stable")
        tree, level = table["tree"][0].as_py(), table["level"][0].as_py()
        digests = [x.encode() for x in table["digest"].take(pa.array(order)).to_pylist()]
        first = int(table["idx"][int(order[0])].as_py())
        whole = first > 0 or len(digests) == size  # else this block is its whole tree
        out: list[tuple[int, int, str]] = []
        for step in range(1, levels + 1):
            if len(digests) == 1 and not whole:
                break
            digests = [_parent(digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
            first //= ARITY
            out += [(level + step, first + i, d.decode()) for i, d in enumerate(digests)]
        return pa.Table.from_arrays([
            pa.array([tree] * len(out), pa.string()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()),
            pa.array([x[2] for x in out], pa.string())], names=_NODE.names)

    level = 0
    while True:
        block = (F.col("idx") / size).cast("bigint")
        above = stored(base.groupBy("tree", block.alias("block")).applyInArrow(run, _NODE), "merkle-nodes")
        found.append(above)
        level += levels
        tops = above.where(F.col("level") == level)
        more = tops.where("idx > 0").select("tree").distinct()
        if more.isEmpty():
            break
        base = tops.join(more, "tree", "left_semi")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _as_nodes(leaves: DataFrame) -> DataFrame:
    return leaves.select("tree", F.lit(0).alias("level"), "idx", "digest")


def build(
    docs: DataFrame, fields: Sequence[str], doc_id: str, group: str, changed: Sequence[Column] | None = None, levels: int = HEIGHT,
) -> Manifest:
    """The manifest of ``docs``; ``changed`` are the fields of a row that was tampered with, to fold its proof from.

    A null in ``changed``'s first column stands for a null field; where nothing was changed the
    columns are the row's own.
    """
    own = quoted(group).cast("string")
    tree = F.when(own.isNull(), F.lit(NULL)).otherwise(F.concat(F.lit(NAMED), own))
    digest = leaf([quoted(c) for c in fields])
    other = digest if changed is None else leaf(changed)
    rows = docs.select(tree.alias("tree"), quoted(doc_id).alias("id"), digest.alias("digest"), other.alias("changed"))
    rows = row_numbers(rows, [F.col("id"), F.col("digest")], "place", ["tree"])
    leaves = stored(rows.select("tree", (F.col("place") - 1).alias("idx"), "id", "digest", "changed"), "merkle-leaves")
    inner = _interiors(_as_nodes(leaves), levels)
    counts = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    heads = _as_nodes(leaves).where("idx = 0").unionByName(inner.where("idx = 0"))
    heads = heads.groupBy("tree").agg(F.max_by("digest", "level").alias("subroot"))
    trees = row_numbers(counts.join(heads, "tree"), [F.col("tree")], "rank")
    trees = stored(trees.select("tree", "n", "subroot", (F.col("rank") - 1).alias("rank")), "merkle-trees")
    top = trees.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("rank").alias("idx"), F.col("subroot").alias("digest"))
    over = _interiors(top, levels)
    nodes = _as_nodes(leaves).unionByName(inner).unionByName(top).unionByName(over)
    root = top.unionByName(over).where("idx = 0").agg(F.max_by("digest", "level")).first()[0]
    return Manifest(leaves, nodes, trees, trees.count(), root)


def prove(manifest: Manifest, asked: DataFrame | None = None, levels: int = HEIGHT, proofs: bool = False) -> DataFrame:
    """Proofs of the leaves ``asked`` (rows of ``manifest.leaves``; all by default).

    id, tree, idx, leaf, subroot, root, proof_sha256 (of the siblings from the leaf's level to the
    root, left to right), folded_root (from ``changed``), verified; and the siblings themselves, in
    hexadecimal, with ``proofs``.
    """
    size, n_trees, root = ARITY ** levels, manifest.n_trees, (manifest.root or "").encode()
    rows = (manifest.leaves if asked is None else asked).withColumn("block", (F.col("idx") / size).cast("bigint"))
    info = stored(rows.select("tree", "block").distinct().join(manifest.trees, "tree"), "merkle-blocks")
    wanted = T.StructType([
        T.StructField("tree", T.StringType()), T.StructField("block", T.LongType()), T.StructField("of", T.StringType()),
        T.StructField("level", T.IntegerType()), T.StructField("idx", T.LongType())])

    def want(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, block = right["tree"][0].as_py(), right["block"][0].as_py()
        out = []
        for of, leaves, n in ((tree, np.unique(np.array(left["idx"])), right["n"][0].as_py()), (TOP, np.array([right["rank"][0].as_py()]), n_trees)):
            out += [(of, level, int(i)) for level, places in missing(leaves, n) for i in places]
        return pa.Table.from_arrays([
            pa.array([tree] * len(out), pa.string()), pa.array([block] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.string()),
            pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64())], names=wanted.names)

    keys = ["tree", "block"]
    need = stored(rows.select(*keys, "idx").groupBy(*keys).cogroup(info.groupBy(*keys)).applyInArrow(want, wanted), "merkle-missing")
    at = manifest.nodes.select(F.col("tree").alias("of"), "level", "idx", "digest")
    fetched = need.join(at, ["of", "level", "idx"]).select(*keys, "of", "level", "idx", "digest", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("rank"))
    told = info.select(*keys, F.lit(None).cast("string").alias("of"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("bigint").alias("idx"), F.col("subroot").alias("digest"), "n", "rank")
    schema = T.StructType([
        rows.schema["id"], *[T.StructField(c, t) for c, t in (("tree", T.StringType()), ("idx", T.LongType()), ("leaf", T.StringType()), ("subroot", T.StringType()), ("root", T.StringType()), ("proof_sha256", T.StringType()), ("folded_root", T.StringType()), ("verified", T.BooleanType()))],
        *([T.StructField("proof", T.StringType())] if proofs else [])])

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes = right.to_pylist()
        head = next(x for x in nodes if x["of"] is None)
        n, rank, subroot = head["n"], head["rank"], head["digest"].encode()
        own, top = [{} for _ in range(height(n) + 1)], [{} for _ in range(height(n_trees) + 1)]
        for x in nodes:
            if x["of"] is not None:
                (top if x["of"] == TOP else own)[x["level"]][x["idx"]] = x["digest"].encode()
        places = left["idx"].to_pylist()
        leaves, changed = ([x.encode() for x in left[c].to_pylist()] for c in ("digest", "changed"))
        own[0].update(zip(places, leaves))
        top[0][rank] = subroot
        beside, found = expand(own, n)
        over, _ = expand(top, n_trees)
        if found != subroot:
            raise ValueError(f"the leaves of {head['tree']!r}, block {head['block']}, do not give its root")
        steps = []  # from the group's root to the root: the same for all rows
        for sides in over:
            steps.append(sides[rank])
            rank //= ARITY
        tail: dict[tuple[int, int], tuple[bytes, list]] = {}  # what rows below a node have in common
        ends = (b"".join(a + b for a, b in steps), steps)
        for level in range(len(beside) - 1, 0, -1):
            for i, sides in beside[level].items():
                rest, path = tail.get((level + 1, i // ARITY), ends)
                tail[level, i] = (sides[0] + sides[1] + rest, [sides, *path])
        out: list[list] = [[], [], []]
        for i, other in zip(places, changed):
            rest, path = tail.get((1, i // ARITY), ends)
            if beside:
                sides = beside[0][i]
                rest, path = sides[0] + sides[1] + rest, [sides, *path]
            for before, after in path:
                other = sha256(before + other + after).hexdigest().encode()
            out[0].append(sha256(rest).hexdigest())
            out[1].append(other.decode())
            out[2].append(rest.decode() if proofs else None)
        rows_, same = len(places), root.decode()
        return pa.Table.from_arrays([
            left["id"], left["tree"], left["idx"], left["digest"], pa.array([head["digest"]] * rows_, pa.string()), pa.array([same] * rows_, pa.string()),
            pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array([x == same for x in out[1]], pa.bool_()),
            *([pa.array(out[2], pa.string())] if proofs else [])], names=schema.names)

    # toDF names the columns anew: the leaves stand on both sides.
    right = fetched.unionByName(told).toDF(*fetched.columns)
    return rows.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(give, schema)
