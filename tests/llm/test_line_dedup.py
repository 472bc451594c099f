"""Line dedup against brute force; the given tables are checked by SQL in test_oracles."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import line_dedup
from tests.llm.fixtures import awkward, nothing


def brute(pages, ratio, least, keep_copied=False):
    total = Counter(h for h, _ in pages)
    seen = Counter((h, x) for h, t in pages for x in set((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c"))
    drop = {k for k, n in seen.items() if total[k[0]] >= least and n > ratio * total[k[0]]}
    out = []
    for h, t in pages:
        lines = None if t is None else t.split("\n")
        kept = lines and [x for x in lines if (h, x) not in drop]
        if lines is None or len(kept) == len(lines) or keep_copied and not any(x.strip(" \t\n\r\x0b\x0c") for x in kept):
            out.append((h, t, t, len(lines or []), 0))
        else:
            out.append((h, t, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def pages():
    out = [("a", f"menu\nitem {i}\n\nfooter" + ("\nrare" if i < 3 else "")) for i in range(40)]
    out += [("b", f"menu\nitem {i}") for i in range(5)] + [(None, f"none\n{i}\nnone") for i in range(30)]
    return out + [("a", "menu\nfooter"), ("a", None), ("a", ""), ("a", "menu\nitem 1"), ("a", "menu\nitem 1"), ("c", "alone"), ("a", "menu\r\nother"), ("a", " \nmenu\n\t")]


@pytest.mark.parametrize("bound", [1 << 26, 0])
@pytest.mark.parametrize("ratio", [0.1, 0.5, 0.999])
@pytest.mark.parametrize("copied", [False, True])
def test_equals_brute_force(spark, bound, ratio, copied):
    df = spark.createDataFrame([(*p, "mine") for p in pages()], "source string, text string, host string")
    out = line_dedup.drop_lines(df, out="clean", ratio=ratio, counts=True, broadcast_bytes=bound, keep_copied=copied)
    assert out.columns == ["source", "text", "host", "n_lines", "n_dropped", "clean"]
    got = sorted([(r["source"], r["text"], r["clean"], r["n_lines"], r["n_dropped"]) for r in out.collect()], key=repr)
    assert got == brute(pages(), ratio, line_dedup.MIN_PAGES, copied)


def test_a_page_of_nothing_but_boilerplate_loses_it(spark):
    rows = [("a", f"We use cookies\ntext {i}") for i in range(20)] + [("a", "We use cookies"), ("a", "We use cookies\n\n")]
    df = spark.createDataFrame(rows, "source string, text string")
    short = lambda keep: sorted(r["text"] for r in line_dedup.drop_lines(df, keep_copied=keep).collect() if "text" not in r["text"])
    assert short(False) == ["", "\n"] and short(True) == ["We use cookies", "We use cookies\n\n"]


def test_awkward_rows(spark):
    docs = awkward(spark, 12)
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("host is not null").count() == 0 if "host" in out.columns else True
    got = sorted([(r["source"], r["text"]) for r in out.collect()], key=repr)
    expected = sorted([(h, c) for h, _, c, _, _ in brute([(r["source"], r["text"]) for r in docs.collect()], 0.1, 20)], key=repr)
    assert got == expected
    assert line_dedup.drop_lines(nothing(spark)).count() == 0
    assert docs.where(F.col("text").isNull()).count() == out.where(F.col("text").isNull()).count()


def test_stage_drops_what_a_source_repeats(spark):
    """A line on 2 % of a source's pages goes, and one that chance repeats stays."""
    import corpus_pipeline

    texts = [f"text {i}\nand more {i}" + ("\nRead the terms" if i % 50 == 0 else "") + ("\nby chance" if i < 3 else "") for i in range(500)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["text"] for r in dict(corpus_pipeline.STAGES)["lines"](spark, docs, "").collect()]
    assert sum("Read the terms" in t for t in got) == 0
    assert sum("by chance" in t for t in got) == 3 and sum("and more" in t for t in got) == 500
