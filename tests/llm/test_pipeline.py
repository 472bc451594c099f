"""The pipeline's stages, one after the other, against what each should do."""

from __future__ import annotations

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import byte_bpe, language_id
from tests.llm.fixtures import awkward, nothing
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_near_copies import least_ids


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_on_given_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    # language: what the dictionaries reject goes
    sizer = language_id.Sizer(language_id.learn(docs, F.lit(True)))
    expected = [r for r in docs.collect() if (j := sizer.judge(r["text"]))[0] != "und" and j[2] >= language_id.MIN_MARGIN]
    one = stages["language"](spark, docs, sf_dir)
    assert one.columns == docs.columns and as_rows(one) == sorted(map(tuple, expected), key=repr)
    assert len(expected) >= 0.97 * docs.count()
    # lines
    cleaned = {r["doc_id"]: r for r in stages["lines"](spark, one, sf_dir).collect()}
    texts = lines([(r["source"], r["text"]) for r in expected], corpus_pipeline.LINE_RATIO, corpus_pipeline.LINE_PAGES, keep_copied=True)
    assert sorted([(r["source"], r["text"]) for r in cleaned.values()], key=repr) == sorted([(h, c) for h, _, c, _, _ in texts], key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned.values())
    # near copies: the least id of each group, by the Jaccard similarity of all pairs
    two = spark.createDataFrame(list(cleaned.values()), docs.schema)
    left = set(least_ids([(i, r["text"]) for i, r in cleaned.items()]).values())
    three = stages["near copies"](spark, two, sf_dir)
    assert as_rows(three) == sorted([tuple(cleaned[i]) for i in left], key=repr)
    # benchmark
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([(i, cleaned[i]["text"]) for i in left], items) if r[-1]}
    four = stages["benchmark"](spark, three, sf_dir)
    assert as_rows(four) == sorted([tuple(cleaned[i]) for i in left - bad], key=repr)
    # tokens
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(final) == left - bad
    for i, r in final.items():
        assert r["token_ids"] == library.encode_ordinary(cleaned[i]["text"]) and r["n_tokens"] == len(r["token_ids"])


def test_awkward_and_empty_tables(spark, sf_dir):
    for docs in (awkward(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
