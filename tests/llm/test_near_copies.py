"""Near copies against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from plumbline.llm import near_copies, simhash_dedup
from tests.llm.fixtures import awkward, nothing


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def least_ids(docs):
    """{id: least id of its group}, by all pairs."""
    docs = sorted(docs)
    sets, root = [shingles(t) for _, t in docs], {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(docs):
        for y in range(x):
            if similar(sets[x], sets[y]):
                a, b = find(i), find(docs[y][0])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in docs}


def test_stage_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = set(least_ids([(r["doc_id"], r["text"]) for r in docs.collect()]).values())
    got = [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near copies"](spark, docs, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize("bucket", [1, 32])
def test_large_groups_and_edits(spark, bucket):
    rng = random.Random(7)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    docs = []
    for size, length, edits in ((150, 300, 3), (2, 400, 4), (2, 200, 2), (40, 120, 1), (3, 6, 0), (2, 100, 30)):
        base = new(length)
        for _ in range(size):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + i, t) for i, t in enumerate([" ".join(new(80)), "", None, "one", "ONE "])]
    got = {r["id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), bucket=bucket).collect()}
    assert got == least_ids(docs)


@pytest.mark.parametrize(("block", "set_bound", "seed"), [(64, 512, 1), (7, 0, 2), (7, 295, 1)])
def test_loosely_linked_family_loses_nothing(spark, monkeypatch, block, set_bound, seed):
    """Variants of one page, most of them too far from each other, in many groups under the same large keys."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    docs = []
    for _ in range(140):
        w = list(base)
        for _ in range(5):
            w[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
        twin = list(w)
        twin[rng.randrange(300)] = "twin"
        docs += [(len(docs), " ".join(w)), (len(docs) + 1, " ".join(twin))]
    monkeypatch.setattr(near_copies.left_open, "__defaults__", (0.8, 8, block, set_bound))
    expected = least_ids(docs)
    assert 20 < len(set(expected.values())) < 140
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = near_copies.stored(near_copies.marked(df), "test-marks")
    nodes = marks.select("fp", "keys", "sketch", near_copies.F.size("shingles").alias("n"))
    members = near_copies.keyed(nodes)
    assert members.agg(near_copies.F.max("size")).first()[0] > 100
    got = {r["id"]: r["component_id"] for r in near_copies.near_copies(df, bucket=8).collect()}
    assert got == expected


@pytest.mark.parametrize("bucket", [2, 32])
def test_groups_of_fingerprints_are_candidates(spark, bucket):
    """Without any min-hash key the links are those that SimHash groups and the whole sets allow."""
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(900))
        texts += [base, f"{base} one", f"{base} two"]
    repeated = "a b c d e f g " * 150  # repeats weigh in a fingerprint, not in a set
    texts += [repeated + " ".join(f"{x}{i}" for i in range(8)) for x in "xy"] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = near_copies.stored(near_copies.marked(df).withColumn("keys", near_copies.F.expr("cast(array() as array<bigint>)")), "test-marks")
    group = {r["id"]: r["component_id"] for r in simhash_dedup.near_duplicates(df).collect()}
    assert group[36] == group[37] and len(set(group.values())) < 30
    expected = {i: i for i in range(len(texts))}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if group[i] == group[j] and similar(shingles(a), shingles(b)):
                expected[i] = min(expected[i], expected[j])
    found = near_copies.named(marks.select("id", "text_hash", "fp"), near_copies.links(marks, bucket=bucket)).collect()
    assert {r["id"]: r["component_id"] for r in found} == expected


def test_awkward_rows(spark):
    docs = awkward(spark, 3)
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({frozenset(shingles(r["text"])) for r in docs.collect()})
    assert near_copies.drop_near_copies(nothing(spark)).count() == 0


def test_no_row_for_each_key_is_broadcast(spark, monkeypatch):
    """Spark takes exploded keys, and lists that pack well, for small tables."""
    plans = {}

    def noted(df, name):
        plans[name] = plans.get(name, "") + df._jdf.queryExecution().sparkPlan().toString()
        return stored(df, name)

    stored = near_copies.stored
    monkeypatch.setattr(near_copies, "stored", noted)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    docs = []
    for _ in range(40):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        docs.append((len(docs), " ".join(w)))
    got = {r["id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), bucket=4).collect()}
    assert got == least_ids(docs)
    asked = ["near-members", "near-firsts", "near-candidates", "near-open-members", "near-open-nodes", "near-open-blocks", "near-open", "near-links"]
    assert [n for n in asked if "Broadcast" in plans[n]] == []


def test_many_nodes_are_not_sent_to_the_driver(spark, monkeypatch):
    """A node that is asked for takes more of the driver than its eight bytes."""
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o p q r s t u v w x y z x{i}") for i in range(8)], "doc_id long, text string")
    marks = near_copies.stored(near_copies.marked(docs), "test-marks")
    pairs = marks.select(near_copies.F.max("fp").alias("u"), near_copies.F.min("fp").alias("v"))
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return stored(df, name)

    stored = near_copies.stored
    monkeypatch.setattr(near_copies, "stored", noted)
    assert near_copies.verified(marks, pairs, broadcast_bytes=64).count() == 1 and "Broadcast" not in plans["near-sets"]
    assert near_copies.verified(marks, pairs, broadcast_bytes=1024).count() == 1 and "Broadcast" in plans["near-sets"]
