"""Character corpora: vocabularies, codes, windows and entropy of text by document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans import ordering


def characters(text: Column) -> Column:
    """A text's code points, each a string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(char, n) of every character."""
    return docs.select(F.explode(characters(F.col(text))).alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(char, id): distinct characters in order of their code points, numbered from 0.  Bounded by Unicode."""
    chars = frequencies(docs, text).select("char", F.ascii("char").alias("code"))
    return chars.select("char", (F.row_number().over(Window.orderBy("code")) - 1).cast("bigint").alias("id"))


def encoded(docs: DataFrame, alphabet: Sequence[str], text: str = "text", out: str = "codes") -> DataFrame:
    """Adds each character's place in ``alphabet``; characters that are not in it are dropped."""
    table = F.create_map(*[x for i, c in enumerate(alphabet) for x in (F.lit(c), F.lit(i))])
    return docs.withColumn(out, F.filter(F.transform(characters(F.col(text)), lambda c: F.try_element_at(table, c)), lambda x: x.isNotNull()))


def decoded(df: DataFrame, alphabet: Sequence[str], codes: str = "codes", out: str = "decoded") -> DataFrame:
    letters = F.array(*[F.lit(c) for c in alphabet])
    return df.withColumn(out, F.array_join(F.transform(codes, lambda i: F.element_at(letters, i + 1)), ""))


def offsets(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, start, length): where each document's characters lie in the whole, in order of the key."""
    sized = docs.select(key, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("length"))
    cum = ordering.cumulate(sized, [F.col(key)], {"upto": F.col("length")})
    return cum.select(key, (F.col("upto") - F.col("length")).alias("start"), "length")


def windows(docs: DataFrame, key: str, size: int, text: str = "text") -> DataFrame:
    """(key, at, x, y): stretches of ``size`` characters side by side, and the same one further on."""
    n = F.length(text)
    at = F.when(n > size, F.sequence(F.lit(0), F.greatest(n - size - 1, F.lit(0)), F.lit(size)))
    rows = docs.select(key, text, F.explode(at).alias("at"))
    return rows.select(key, F.col("at").cast("bigint").alias("at"), F.substring(text, F.col("at") + 1, F.lit(size)).alias("x"), F.substring(text, F.col("at") + 2, F.lit(size)).alias("y"))


def entropy(counts: DataFrame) -> DataFrame:
    """(n_chars, n_vocab, unigram_bits, uniform_bits) from (char, n)."""
    n = F.col("n")
    s = counts.agg(F.sum("n").alias("t"), F.sum(n * F.log2(n.cast("double"))).alias("s"), F.count(F.lit(1)).alias("v"))
    return s.select(F.col("t").alias("n_chars"), F.col("v").alias("n_vocab"), (F.log2(F.col("t").cast("double")) - F.col("s") / F.col("t")).alias("unigram_bits"), F.log2(F.col("v").cast("double")).alias("uniform_bits"))
