"""Quality rules by distribution divergence.  DataFrame functions only.

Every document gets simple counts, and two Jensen-Shannon distances (base 2, 0 to 1) between
its own distributions and those of its language: the classes of its characters (lower case,
upper case, digit, symbol, other; white space apart) and its shares of the language's common words.
A language's reference comes from all its documents: one count of (language, word), from which
both distributions follow.  A common word has at least ``min_share`` of the language's words,
so there are at most 1 / ``min_share`` of them; a language has a reference of its own with at
least 1 % of all words, so there are at most 100, and any other language, null included, is
compared with all documents together.  The references are therefore a bounded table, and are
literals of the plan.

A text is far by its words beyond ``max_word``, which overuse reaches, or if it has fewer common words
than the language and over ``lack_share`` of the distance of a text with none of them.

The distances are judged only from ``min_words`` words on: short texts vary too much.

Edge cases: null and empty texts have no words, distances null, and fail the base rules;
repeated rows are judged each; a table without any word has no reference, and no distance is
judged; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ASCII_SPACE, pieces, quoted, stored

MIN_SHARE = 0.005
MIN_LANGUAGE_SHARE = 0.01
MIN_WORDS = 30
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.45
#: A text lacks the common words from this share of the distance that a text with none of them has.
LACK_SHARE = 0.9
WINDOW = 8


@dataclass(frozen=True)
class Reference:
    """Shares of character classes, and of common words, of one language."""

    classes: tuple[float, ...]
    words: dict[str, float]


def _class_counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Adds n_lower, n_upper, n_digit, n_other, n_space and n_symbols of ``text``.

    Each step works on what the one before has left over.
    """
    n = lambda a, b: (F.length(a) - F.length(b)).cast("bigint")
    out = df.select(*keep, text, F.regexp_replace(text, r"\p{Ll}+", "").alias("r1"))
    out = out.select(*keep, text, "r1", F.regexp_replace("r1", ASCII_SPACE, "").alias("r2"))
    out = out.select(*keep, text, "r1", "r2", F.regexp_replace("r2", r"\p{Lu}+", "").alias("r3"))
    out = out.select(*keep, text, "r1", "r2", "r3", F.regexp_replace("r3", r"\p{Nd}+", "").alias("r4"))
    return out.select(
        *keep, n(text, "r1").alias("n_lower"), n("r1", "r2").alias("n_space"), n("r2", "r3").alias("n_upper"),
        n("r3", "r4").alias("n_digit"), n("r4", F.regexp_replace("r4", r"[#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("r4", r"[#*$%&|<>]+", "")).cast("bigint").alias("n_other"),
    )


CLASSES = ("n_lower", "n_upper", "n_digit", "n_symbols", "n_other")


def references(docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE) -> dict:
    """{language: Reference}; at None, that of all documents.  Bounded, see above."""
    words = docs.select(quoted(lang).alias("lang"), F.explode(pieces(quoted(text), ASCII_SPACE)).alias("word"))
    counts = stored(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    classes = _class_counts(counts, "word", ["lang", "n"])
    sums = [F.sum(F.col(c) * F.col("n")).alias(c) for c in CLASSES]
    per_lang = classes.groupBy("lang").agg(F.sum("n").alias("n"), *sums)
    floor = per_lang.agg(F.sum("n").alias("all")).first()["all"]
    if not floor:
        return {}
    totals = {r["lang"]: r for r in per_lang.where(F.col("n") >= MIN_LANGUAGE_SHARE * floor).collect()}
    everything = per_lang.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in CLASSES]).first()
    by_word = counts.where(F.col("n") >= min_share * MIN_LANGUAGE_SHARE * floor)
    least = F.lit(None).cast("double")
    for name, r in totals.items():
        least = F.when(F.col("lang").eqNullSafe(F.lit(name)), min_share * r["n"]).otherwise(least)
    common = {}
    for r in by_word.where(F.col("n") >= least).collect():
        common.setdefault(r["lang"], {})[r["word"]] = r["n"] / totals[r["lang"]]["n"]
    candidates = sorted({w for words in common.values() for w in words})
    pooled = {
        r["word"]: r["n"] / floor
        for r in counts.where(F.col("word").isin(candidates)).groupBy("word").agg(F.sum("n").alias("n")).collect()
        if r["n"] >= min_share * floor
    } if candidates else {}
    out = {}
    for name, r in [*totals.items(), (None, everything)]:
        chars = max(1, sum(r[c] for c in CLASSES))
        own = pooled if name is None else common.get(name, {})
        out[name] = Reference(tuple(r[c] / chars for c in CLASSES), dict(sorted(own.items(), key=lambda x: (-x[1], x[0]))))
    return out


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance of two distributions, given as arrays of the same length."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: 0.5 * part(a, b) + 0.5 * part(b, a))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _with_later(hashes: str, by: int):
    """Combines a hash with the one ``by`` places on."""
    return lambda x, i: F.xxhash64(x, F.get(hashes, i + by))


def repeated_words(w: Column, window: int = WINDOW) -> tuple[list[tuple[str, Column]], Column]:
    """Column steps, and then the number of words in windows that occur twice or more.

    Hashes of 1, 2, 4, ... words are combined to those of the window; the positions whose hash
    occurs again are found by sorting, and their union is measured.
    """
    steps = [("h", F.transform(w, lambda x: F.xxhash64(x)))]
    size = 1
    while size < window:
        by = min(size, window - size)
        steps.append(("h", F.transform("h", _with_later("h", by))))
        size += by
    steps.append(("h", F.slice("h", 1, F.greatest(F.lit(0), F.size("h") - (window - 1)))))
    twice = F.size(F.array_distinct("h")) < F.size("h")
    sorted_ = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    steps.append(("s", F.when(twice, sorted_)))
    again = F.filter("s", lambda x, i: (x["h"] == F.get("s", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("s", F.greatest(i - 1, F.lit(0)))["h"])))
    steps.append(("at", F.array_sort(F.transform(again, lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("at", lambda x, i: F.least(F.lit(window), F.coalesce(F.get("at", i + 1) - x, F.lit(window)))),
        F.lit(0), lambda s, x: s + x)
    return steps, F.coalesce(covered, F.lit(0)).cast("bigint")


def judge(
    docs: DataFrame, refs: dict | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    min_words: int = MIN_WORDS, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
    lack_share: float = LACK_SHARE,
) -> DataFrame:
    """One row per row of ``docs``: id, lang, the counts, base_failed, class_distance, word_distance, kept."""
    refs = references(docs, text, lang) if refs is None else refs
    own = [k for k in refs if k is not None]
    t = docs.select(
        quoted(doc_id).alias("id"), quoted(lang).cast("string").alias("lang"),
        F.coalesce(quoted(text), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = t.select("id", "lang", "t", pieces(F.col("t"), ASCII_SPACE).alias("w"), lines.alias("lines"))
    out = out.select("id", "lang", "t", "w", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"))
    keep = ["id", "lang", "w", "n_dup_lines"]
    out = _class_counts(out, "t", keep)
    keep += [*CLASSES]
    known = sorted({w for r in refs.values() for w in r.words})
    hits = F.filter("w", lambda x: x.isin(known)) if known else F.array().cast("array<string>")
    out = out.select(*keep, hits.alias("hits"))
    steps, n_repeat = repeated_words(F.col("w"))
    n_words = F.size("w").cast("bigint")
    out = out.select(*[c for c in keep if c != "w"], "hits", n_words.alias("n_words"), "w")
    keep = [c for c in keep if c != "w"] + ["hits", "n_words"]
    have = ["w"]
    for name, step in steps:
        out = out.select(*keep, *[c for c in have if c not in (name, "w")], step.alias(name))
        have = [c for c in have if c not in (name, "w")] + [name]
    out = out.select(*keep, n_repeat.alias("n_repeat_words"))
    chars = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))

    def for_lang(pick) -> Column:
        """The language's own literal, or the one of all documents."""
        column = pick(refs[None])
        for name in own:
            column = F.when(F.col("lang") == name, pick(refs[name])).otherwise(column)
        return column

    if refs:
        shares = F.transform(F.array(*CLASSES), lambda c: c / F.greatest(chars, F.lit(1)))
        class_distance = jensen_shannon(shares, for_lang(lambda r: _literals(r.classes)))
        out = out.withColumn("_words", for_lang(lambda r: _literals(r.words).cast("array<string>")))
        out = out.withColumn("_own", F.transform("_words", lambda x: (F.size("hits") - F.size(F.array_remove("hits", x))) / F.greatest(F.col("n_words"), F.lit(1))))
        rest = lambda a: F.concat(a, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))))
        word_distance = jensen_shannon(
            rest(F.col("_own")), for_lang(lambda r: _literals([*r.words.values(), max(0.0, 1 - sum(r.words.values()))])))
        shares_of = lambda r: [*r.words.values(), max(0.0, 1 - sum(r.words.values()))]
        none = for_lang(lambda r: jensen_shannon(_literals([*[0.0] * len(r.words), 1.0]), _literals(shares_of(r))))
        covered = F.aggregate("_own", F.lit(0.0), lambda s, x: s + x)
        lacks = (covered < for_lang(lambda r: F.lit(float(sum(r.words.values()))))) & (word_distance > lack_share * none)
    else:
        lacks = F.lit(False)
        class_distance = word_distance = F.lit(None).cast("double")
    out = out.withColumns({
        "word_chars": chars,
        "base_failed": base_failed,
        "class_distance": F.when(F.col("n_words") > 0, class_distance),
        "word_distance": F.when(F.col("n_words") > 0, word_distance),
        "_lacks": lacks,
    })
    far = (F.col("n_words") >= min_words) & ((F.col("class_distance") > max_class) | (F.col("word_distance") > max_word) | F.col("_lacks"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).select(
        "id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "word_distance", "kept")
