"""What a table holds: size, columns, and a fingerprint that does not depend on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(df: DataFrame, name: str, rule: str = "", licence: str = "") -> DataFrame:
    """One row: name, n_rows, n_columns, columns, fingerprint, rule, licence."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    digest = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), digest.alias("fingerprint")).select(
        F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(columns).alias("columns"), "fingerprint",
        F.lit(rule).alias("rule"), F.lit(licence).alias("licence"))


def upsert(known: DataFrame, new: DataFrame) -> DataFrame:
    """``known`` with the rows of ``new`` in place of those of the same name."""
    return known.join(new.select("name"), "name", "left_anti").unionByName(new)


def unchanged(df: DataFrame, stored: DataFrame, name: str) -> bool:
    """Whether a table still has the row count and fingerprint of its manifest."""
    both = manifest(df, name).select("n_rows", "fingerprint").exceptAll(stored.where(F.col("name") == name).select("n_rows", "fingerprint"))
    return both.isEmpty()
