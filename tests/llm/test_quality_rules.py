"""Quality rules against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality_rules
from plumbline.llm.queries import QUERIES
from tests.llm.fixtures import awkward, nothing

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    out = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    return (*out, out[0] < 20 or 100 * out[4] > 30 * out[0])


def classes(text):
    import unicodedata

    c = Counter()
    for x in "".join(SPACE.findall(text or "")):
        k = unicodedata.category(x)
        c["lower" if k == "Ll" else "upper" if k == "Lu" else "digit" if k == "Nd" else "symbol" if x in "#*$%&|<>" else "other"] += 1
    return [c[k] for k in ("lower", "upper", "digit", "symbol", "other")]


def distance(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(0.5 * part(a, b) + 0.5 * part(b, a) for a, b in zip(p, q))))


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    refs = {}
    for lang in {d["lang"] for d in docs.values()}:
        words, chars = Counter(), [0] * 5
        for d in docs.values():
            if d["lang"] == lang:
                words.update(SPACE.findall(d["text"] or ""))
                chars = [a + b for a, b in zip(chars, classes(d["text"]))]
        n = sum(words.values())
        refs[lang] = [c / sum(chars) for c in chars], {w: c / n for w, c in words.items() if c >= 0.005 * n}
    got = QUERIES["op7_quality_rules"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        d = docs[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(d["text"])
        ref_classes, ref_words = refs[d["lang"]]
        c, w = classes(d["text"]), Counter(SPACE.findall(d["text"] or ""))
        own = [w[x] / r["n_words"] for x in ref_words]
        by_class = distance([x / sum(c) for x in c], ref_classes)
        by_word = distance([*own, max(0, 1 - sum(own))], [*ref_words.values(), max(0, 1 - sum(ref_words.values()))])
        assert r["class_distance"] == pytest.approx(by_class, abs=1e-6) and r["word_distance"] == pytest.approx(by_word, abs=1e-6)
        far = r["n_words"] >= quality_rules.MIN_WORDS and (by_class > quality_rules.MAX_CLASS_DISTANCE or by_word > quality_rules.MAX_WORD_DISTANCE)
        assert r["kept"] == (not r["base_failed"] and not far)


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op7_quality_rules"](spark, sf).collect() if r["doc_id"] in labels and r["n_words"] >= 30]
    good = [r["kept"] for r in got if labels[r["doc_id"]]]
    bad = [r["kept"] for r in got if not labels[r["doc_id"]]]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.5 * len(bad)


@pytest.mark.parametrize("text", [
    "a b c d e f g h " * 2, "a b c d e f g h i " * 2, "a " * 9, "a " * 8, "x a b c d e f g h y a b c d e f g h z", "a b c d e f g", "l\nl\n\n \nl", "    wide　space", "# * $ %& |<>", "ÄÖ ß ǅ Ⅷ ٣"])
def test_counts(spark, text):
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    r = quality_rules.judge(df).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(text)


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = quality_rules.judge(docs)
    assert out.count() == docs.count()
    expected = {(r["doc_id"], base(r["text"])) for r in docs.collect()}
    assert {(r["id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in out.collect()} == expected
    assert out.where("kept is null").count() == 0
    assert quality_rules.judge(nothing(spark)).count() == 0
    assert quality_rules.judge(docs.withColumn("text", F.lit(None).cast("string"))).where("kept").count() == 0


def test_text_in_the_wrong_language_goes(spark):
    english, german = "the cat and dog of a house".split(), "der Hund und die Katze im Haus".split()
    text = lambda common, i: " ".join(f"{common[(i + j) % len(common)]} {common[(i * j) % len(common)]} w{i}x{j} v{i}y{j} u{i}z{j}" for j in range(20))
    docs = [(i, text(english, i), "en") for i in range(60)] + [(100 + i, text(german, i), "de") for i in range(60)] + [(200, text(german, 70), "en")]
    got = {r["id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert not got.pop(200) and all(got.values())
