"""Decontamination against brute force."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate
from tests.llm.fixtures import PHRASE, awkward, nothing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), sorted(str(f) for f in found if f is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def both(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(d, b, **options)
    return sorted([(r["id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()], key=repr), brute(docs, items)


ITEMS = [(1, PHRASE), (2, "Short item"), (3, ""), (4, None), (5, PHRASE.upper() + " more"), (None, "nameless thing here"), (2, "Short item"), (6, "solo"), (70, "éa b C d é F g h i j k l m n o")]
DOCS = [
    (1, "x " + PHRASE + " y"), (2, PHRASE.replace(" ", ", ").title()), (3, "short ITEM short item"), (4, None), (5, ""), (6, "beta gamma delta"), (7, PHRASE + " " + PHRASE),
    (8, " ".join(PHRASE.split()[3:16])), (9, " ".join(PHRASE.split()[3:15])), (9, " ".join(PHRASE.split()[3:16])), (10, "the nameless thing here"), (11, "solo " * 30 + "solo"),
    (12, "éa b c d é f g h i j k l m"), (13, "Éa b c d é f g h i j k l m"), (None, PHRASE), (14, "w " * 300 + PHRASE), (15, "w " * 400 + "solo"), (1, "x " + PHRASE + " y"),
]


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_equals_brute_force(spark, bound):
    got, expected = both(spark, DOCS, ITEMS, broadcast_bytes=bound)
    assert got == expected


@pytest.mark.parametrize("length", range(1, 16))
def test_every_length_and_offset(spark, length):
    w = [f"v{i}" for i in range(40)]
    docs = [(i, " ".join(w[i : i + length])) for i in range(20)] + [(100 + i, " ".join(["z"] * i + w[5 : 5 + length] + ["y"])) for i in range(9)]
    got, expected = both(spark, docs, [(1, " ".join(w[4 : 4 + length])), (2, " ".join(w[:25]))])
    assert got == expected


def test_given_tables(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got, expected = both(spark, [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == expected


def test_removal(spark):
    d, b = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("spans", F.lit("mine")), spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {r["id"] for r in decontaminate.scan(d, b).where("contaminated").collect()}
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in DOCS if i not in bad or i == 9}
    clean = decontaminate.remove_spans(d, b)
    assert clean.count() == len(DOCS) and clean.where("spans != 'mine'").count() == 0
    again = decontaminate.scan(clean.select("doc_id", F.col("clean_text").alias("text")), b)
    assert again.where("n_hit > 0").count() == 0
    assert {r["clean_text"] for r in clean.where("doc_id = 1").collect()} == {"x y"}


def test_awkward_rows(spark):
    docs = awkward(spark)
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.scan(docs, b).count() == docs.count()
    assert decontaminate.scan(nothing(spark), b).count() == 0
    assert decontaminate.scan(docs, b.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs, b.limit(0)).count() == docs.count()


def test_grams_beyond_the_bound_are_not_broadcast(spark, tmp_path):
    """Spark sizes the benchmark's grams by the items' file, though each word makes one of up to 25 words."""
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/items")
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs, items = spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/items")
    for bound, broadcast in ((0, False), (1 << 26, True)):
        found = decontaminate.scan(docs, items, broadcast_bytes=bound)
        assert ("Broadcast" in found._jdf.queryExecution().sparkPlan().toString()) == broadcast
