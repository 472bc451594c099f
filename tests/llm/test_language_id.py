"""Language identification by its accuracy on rows held out."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from plumbline.llm import language_id
from plumbline.llm.queries import QUERIES
from tests.llm.fixtures import awkward, nothing


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_language_id"](spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)
    assert sum(r["rejected"] for r in got) <= 0.03 * len(got)


def test_awkward_rows(spark):
    docs = awkward(spark)
    dictionaries = language_id.learn(docs, F.lit(True))
    assert sorted(dictionaries) == ["de", "en"]
    out = language_id.identify(docs, dictionaries)
    assert out.count() == docs.count()
    for r in out.collect():
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in ("de", "en") and r["score"] >= 0.5
        assert r["h"] == "h"
    assert out.schema["score"].dataType.simpleString() == "double"  # the clashing column is replaced
    assert language_id.identify(nothing(spark), dictionaries).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.learn(nothing(spark), F.lit(True))).collect()} == {"und"}


def test_narrow_margins_are_rejected(spark):
    texts = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "vala tuma rike noso pelu gani"}
    dictionaries = {k: (v + " ").encode() * 5 for k, v in texts.items()}
    docs = spark.createDataFrame([(texts["aa"],), (texts["bb"],), ("zzqx",)], "text string")
    got = {r["text"]: r for r in language_id.identify(docs, dictionaries).collect()}
    assert [got[texts[k]]["lang_pred"] for k in texts] == ["aa", "bb"]
    assert got["zzqx"]["rejected"] and got["zzqx"]["lang_pred"] == "aa"  # a tie goes to the first


def test_a_later_part_of_a_long_text_counts():
    dictionaries = {"aa": b"lorem ipsum dolor sit amet consectetur adipiscing elit", "bb": b"vala tuma rike noso pelu gani meto suri kalo bine"}
    sizer = language_id.Sizer(dictionaries)
    head = " ".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(3000))
    assert sizer.judge(head + " vala tuma rike noso pelu gani meto suri kalo bine")[0] == "bb"


def test_copies_fill_no_dictionary_and_the_end_of_a_text_is_sampled(spark):
    copies = [("en", "copied words " * 300)] * 2000
    others = [("en", " ".join(chr(97 + i) * 3 + chr(97 + j) * 2 for j in range(20))) for i in range(20)]
    long = [("de", "anfang " * 20_000 + "schluss")]
    docs = spark.createDataFrame(copies + others + long, "lang string, text string")
    found = language_id.learn(docs, F.lit(True))
    assert found["en"].split().count(b"copied") == 1
    assert all(word in found["en"] for _, t in others for word in t.encode().split())
    assert b"schluss" in found["de"]
    assert all(len(v) <= 100 for v in language_id.learn(docs, F.lit(True), dictionary_bytes=100).values())
    assert len(language_id.learn(docs, F.lit(True), sample_docs=1, slice_bytes=64)["en"]) <= 64
