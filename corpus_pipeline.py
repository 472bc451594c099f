"""A training corpus from raw documents: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  Null texts go at the first stage; nulls elsewhere, repeated rows,
empty tables and extra columns are as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, decontaminate, language_id, line_dedup, near_copies
from plumbline.llm.common import stored

#: A source's repeated lines are on 1 to 10 % of its pages, others far below; the page count guards against chance.
LINE_RATIO, LINE_PAGES = 0.005, 4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; dictionaries are learned from the stage's own input."""
    dictionaries = language_id.learn(docs, F.lit(True))
    found = language_id.identify(docs, dictionaries)
    return found.where(~F.col("rejected")).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that their source repeats; n_chars follows.  Copied pages are left to the next stage."""
    cleaned = line_dedup.drop_lines(docs, "source", "text", ratio=LINE_RATIO, least_pages=LINE_PAGES, keep_copied=True)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast("bigint"))
    return cleaned.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return near_copies.drop_near_copies(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark's passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.decontaminate(docs, benchmark).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    import public_tokenizers

    return byte_bpe.encode(
        docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        digests=True, keep=["doc_id"])


STAGES = [
    ("language", identify_language),
    ("lines", drop_boilerplate),
    ("near copies", drop_near_copies),
    ("benchmark", drop_contaminated),
    ("tokens", tokenize),
]
#: Compression sizes, fingerprints, components and merges are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what passes between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
