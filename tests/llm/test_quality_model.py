"""The ranking model by its accuracy on rows held out."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality_model
from plumbline.llm.queries import QUERIES
from tests.llm.fixtures import awkward, nothing


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op2_quality_classifier"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i in labels if got[i]["held_out"]]
    assert len(held) > 40
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) >= 0.95


def test_pairs_order_the_classes():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    x = np.c_[rng.normal(y * 3.0, 1), rng.normal(0, 1, 400)]
    mean, scale, w, threshold = quality_model.fit(x, y, 5000)
    assert w[0] > 5 * abs(w[1])
    assert np.mean((((x - mean) / scale) @ w >= threshold) == y) > 0.9


def test_without_both_labels_every_score_is_the_cut(spark):
    docs = awkward(spark)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    for table in (labels, labels.limit(0)):
        model = quality_model.learn(docs, table, F.lit(True))
        assert {r["score"] for r in quality_model.score(docs, model).collect()} == {0.3}


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).union(spark.createDataFrame([(77, 1), (None, 0), (1, None), (3, 9)], "doc_id long, quality int"))
    model = quality_model.learn(docs, labels, F.lit(True))
    out = quality_model.score(docs, model)
    assert out.count() == docs.count()
    assert out.where("score is null or isnan(score) or score < 0 or score > 1").count() == 0
    by_text = {}
    for r in out.collect():
        assert by_text.setdefault(r["text"], r["score"]) == r["score"]  # nothing but the text counts
    assert quality_model.score(nothing(spark), model).count() == 0
    assert quality_model.learn(nothing(spark), labels, F.lit(True))[3] == 0.0


def test_copies_count_once(spark):
    texts = ["good prose stands here, and it goes on.", "bad bad bad!!", "more good prose, of some length."]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(300)] + [(900, texts[0])], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("text") != texts[1]).cast("int").alias("quality"))
    once = quality_model.learn(docs.limit(3), labels, F.lit(True))
    many = quality_model.learn(docs, labels, F.lit(True))
    assert all(np.array_equal(a, b) for a, b in zip(once, many))
    few = quality_model.learn(docs, labels, F.lit(True), sample_rows=3)
    assert all(np.array_equal(a, b) for a, b in zip(few, many))


def test_every_labelled_text_is_learned_from(spark):
    """Small blocks, one label scarce: moments, pairs and threshold are those of all rows in memory."""
    texts = [f"Text number {i} goes on, with {'some ' * (i % 7)}words." if i % 5 else f"!!! {i} ### {'x ' * (i % 4)}" for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 5 != 0) AS quality")
    mean, scale, w, threshold, _ = quality_model.learn(docs, labels, F.lit(True), block=3)
    x = np.array([quality_model.features(t) for t in texts])
    assert np.allclose(mean, x.mean(0)) and np.allclose(scale, np.where(x.std(0) > 1e-9, x.std(0), 1))
    s = np.sort((x - mean) / scale @ w)
    assert np.isclose(threshold, (s[17] + s[18]) / 2)
    whole = quality_model.learn(docs, labels, F.lit(True))
    assert all(np.allclose(a, b) for a, b in zip(whole, quality_model.fit(x, np.arange(90) % 5 != 0)))
