"""Helpers that the text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters outside ASCII that a Unicode lower-casing would change.
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]"
ASCII_SPACE = r"[\x20\x09-\x0D]+"
#: What separates words once A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables up to this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Row groups of written intermediate tables: what a task holds of its file before it writes.
ROW_GROUP_BYTES = 16 << 20
#: Copies of the small side, and shares of a hot key, in a salted join.
SALTS = 16


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is.

    ``lower`` does the same on texts without other upper-case letters, and is the faster way.
    """
    replaced = text
    for c in UPPER:
        replaced = F.replace(replaced, F.lit(c), F.lit(c.lower()))
    return F.when(text.rlike(OTHER_UPPER), replaced).otherwise(F.lower(text))


def pieces(text: Column, separators: str) -> Column:
    """The non-empty parts of ``text`` between ``separators``; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or a longer one that no column of ``frames`` has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df``, and tables made of it row by row, joined by shuffles only.

    Spark sizes a table by its files, whatever is exploded or unpacked after them, so a table that
    grows with the input can look small enough to be sent to the driver.
    """
    return df.hint("merge")


def small(df: DataFrame, size: Column, bound: int = BROADCAST_BYTES) -> bool:
    """Whether the sum of ``size`` over ``df`` is within ``bound``."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= bound
