"""Digests against a plain recursion, multiproofs against their definition, and tampering."""

from __future__ import annotations

import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle_manifest as mm
from tests.llm.fixtures import awkward, nothing

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row, change=False):
    out = ""
    for c in FIELDS:
        v = row[c]
        if change and c == "text" and v is not None:
            v = "".join(x.lower() if "A" <= x <= "Z" else x for x in v)
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def slow_tree(leaves):
    """The root, and each leaf's siblings by level as (left, right)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            first = i // 8 * 8
            paths[leaf].append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def slow(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of each row; what 3 divides was changed."""
    import zlib

    groups = defaultdict(list)
    for r in rows:
        change = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, slow_leaf(r), slow_leaf(r, change), r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: slow_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, tops = slow_tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            folded = x[3]
            for a, b in path + top:
                folded = h(a, folded, b)
            out.append((x[4], x[2], trees[g][0], root, h(*(a + b for a, b in path + top)), folded))
    return sorted(out, key=repr)


def proved(docs, levels, asked=None):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    manifest = mm.build(docs, FIELDS, "doc_id", "lang", [*map(F.col, FIELDS[:-1]), changed], levels)
    found = mm.prove(manifest, asked and asked(manifest.leaves), levels).collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in found)
    return sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in found), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_equals_plain_recursion(spark, sf_dir, levels):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 7, F.lit("zz")).when(F.col("doc_id") % 11 != 0, F.col("lang")))
    assert proved(docs, levels) == slow(docs.collect())


def test_some_rows_only(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = [r for r in slow(docs.collect()) if r[0] % 7 == 3]
    assert proved(docs, 2, lambda leaves: leaves.where("id % 7 = 3")) == expected


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert proved(docs, 1) == slow(docs.collect())
    assert proved(nothing(spark), 1) == []


def test_one_group_of_most_rows_is_many_blocks(spark):
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") < 1400, "en").otherwise("de").alias("lang"), F.lit(1).alias("n_chars"), F.lit("A").alias("text"))
    assert proved(docs, 1) == slow(docs.collect())


def test_changes_are_found_and_only_they(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = F.when(F.col("doc_id") == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    manifest = mm.build(docs, FIELDS, "doc_id", "lang", [*map(F.col, FIELDS[:-1]), changed])
    assert [r["id"] for r in mm.prove(manifest).where("NOT verified").collect()] == [5]
    whole = mm.prove(manifest, manifest.leaves.where("id = 9"), proofs=True).first()
    assert h(whole["proof"]) == whole["proof_sha256"] and len(whole["proof"]) % 64 == 0


def test_missing_nodes_are_few_and_enough():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 700)
        asked = np.array(sorted(rng.sample(range(n), rng.randint(1, min(n, 40)))))
        leaves = [h(str(i)).encode() for i in range(n)]
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h("".join(x.decode() for x in levels[-1][i : i + 8])).encode() for i in range(0, len(levels[-1]), 8)])
        need = mm.missing(asked, n)
        known = [{} for _ in range(mm.height(n) + 1)]
        for level, places in need:
            # Nothing is fetched that stands above an asked leaf.
            assert not {a // 8**level for a in asked.tolist()} & set(places.tolist())
            known[level].update((int(i), levels[level][i]) for i in places)
        known[0].update((int(a), leaves[a]) for a in asked)
        _, root = mm.expand(known, n)
        assert root == levels[-1][0]
    assert sum(len(p) for _, p in mm.missing(np.arange(64), 64)) == 0
