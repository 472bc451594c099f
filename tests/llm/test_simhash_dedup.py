"""SimHash groups against brute force over all pairs."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash_dedup
from plumbline.llm.queries import QUERIES
from tests.llm.fixtures import awkward, nothing


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(fingerprints):
    """Least member of each one's component, by all pairs."""
    root = list(range(len(fingerprints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fingerprints):
        for j in range(i):
            if bin(a ^ fingerprints[j]).count("1") <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fingerprints))]


def test_fingerprints_equal_sparks_hash(spark):
    text = "The cat  sat\ton the MAT É"
    w = text.replace("MAT", "mat").replace("The", "the").split()
    df = spark.createDataFrame([(" ".join(w[i : i + 3]),) for i in range(len(w) - 2)], "s string")
    hashes = [r[0] & (2**64 - 1) for r in df.select(F.xxhash64("s")).collect()]
    expected = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash_dedup.fingerprint(text) == expected == slow_fingerprint(text)


def test_query_equals_brute_force(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    fps = [slow_fingerprint(t) for _, t in docs]
    expected = {i: (f"{f:016x}", docs[g][0]) for (i, _), f, g in zip(docs, fps, groups(fps))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash"](spark, sf_dir).collect()} == expected


@pytest.mark.parametrize("bucket", [0, 1, 5, 256])
def test_links_give_all_components(spark, bucket):
    rng = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(12):  # clusters of fingerprints around seeds, chains among them
        f = rng.getrandbits(64)
        for _ in range(rng.choice([2, 10, 40])):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            fps.add(f)
    fps |= {1 << b for b in range(64)} | {(1 << b) | 1 for b in range(1, 40)} | {rng.getrandbits(64) for _ in range(60)}
    signed = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash_dedup.links(df, bucket)
    assert found.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 2).count() == 0
    got = {r["node"]: r["root"] for r in simhash_dedup.components(found).collect()}
    expected = groups([f & (2**64 - 1) for f in signed])
    assert [got.get(f, f) for f in signed] == [signed[g] for g in expected]


def test_pairs_of_small_entries_are_all_there(spark):
    fps = [0, 1, 3, 7, 1 << 40, (1 << 40) | 1, (1 << 40) | (1 << 41), 5 << 32]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = sorted((r["u"], r["v"]) for r in simhash_dedup.links(df).collect())
    assert got == sorted((a, b) for a in fps for b in fps if a > b and bin(a ^ b).count("1") <= 2)


def test_components_of_long_chains(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100 + 3 * i, 103 + 3 * i) for i in range(20)] + [(500, i) for i in range(501, 560)] + [(900, 901), (901, 900), (7, 7)]
    got = {r["node"]: r["root"] for r in simhash_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = {i: 0 for i in range(61)} | {100 + 3 * i: 100 for i in range(21)} | {i: 500 for i in range(500, 560)} | {900: 900, 901: 900}
    assert got == expected


def test_awkward_rows(spark):
    docs = awkward(spark, 3)
    out = simhash_dedup.near_duplicates(docs)
    assert out.count() == docs.count()
    zero = [r["component_id"] for r in out.where("fp = 0").collect()]
    assert set(zero) == {2} and len(zero) == 9
    kept = simhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups_ = {(r["component_id"] if r["component_id"] is not None else r["fingerprint"]) for r in out.collect()}
    assert kept.count() == len(groups_)  # exactly one row of each group
    assert {r["text"] for r in kept.where("doc_id is null").collect()} == {r["text"] for r in docs.where("doc_id is null").collect()}
    assert simhash_dedup.near_duplicates(nothing(spark)).count() == 0
    assert simhash_dedup.drop_near_duplicates(nothing(spark)).count() == 0


def test_no_row_for_each_entry_is_broadcast(spark, monkeypatch):
    """Spark takes the exploded entries of few fingerprints for a small table."""
    plans = []

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return stored(df, name)

    stored = simhash_dedup.stored
    monkeypatch.setattr(simhash_dedup, "stored", noted)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=12))) for i in range(60)]
    docs = spark.createDataFrame(docs + [(100 + i, t) for i, t in docs], "doc_id bigint, text string")
    kept = simhash_dedup.drop_near_duplicates(docs)
    assert kept.count() <= 60
    plans += [("simhash-kept", kept._jdf.queryExecution().sparkPlan().toString())]
    edges = simhash_dedup.links(simhash_dedup.fingerprints(docs).select("fp").distinct())
    plans += [("simhash-links", edges._jdf.queryExecution().sparkPlan().toString())]
    asked = [p for n, p in plans if n.startswith("simhash-")]
    assert len(asked) >= 6 and not [p for p in asked if "Broadcast" in p]
