"""Small tables with every awkward case."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, id string, h string, spans string"
PHRASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def awkward(spark, repeat: int = 1):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    texts = [
        (1, "The cat sat on the mat and the dog lay by the door. " + PHRASE, "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"), (4, " \n\t ", None, None),
        (5, "x" * 50_000, "en", "b"), (6, "Wort und Satz in einer langen Zeile der Ärzte ÄÖÜ ß", "de", "b"), (6, "Wort und Satz in einer langen Zeile der Ärzte ÄÖÜ ß", "de", "b"),
        (None, "no id here " + PHRASE, None, "a"), (8, "same\nline\nsame\nline", "en", None), (9, "😀 ünïcode \\ <|im_start|> \x00   done", "en", "a"),
        (10, " ".join(f"w{i % 50}" for i in range(20_000)), "en", "c"), (11, "12 34 56", "en", "c"), (12, "one", "de", "c"),
        (6, "another text under the same id", "de", "b"),
    ] * repeat
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "s", "i", "h", "p") for r in texts], SCHEMA)


def nothing(spark):
    return awkward(spark).where(F.lit(False))


def rows(df, *columns):
    """The rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
