"""Language identification by compression.

Per language, a zstandard dictionary of raw content is put together from labelled texts; a text
is compressed with each dictionary, and the one that makes it smallest names the language.  A
text's distinct words are what is compressed, in chunks, all of them, so that the dictionary
helps everywhere and a repeated word does not drown the rest.  Only letters count: texts are
lower-cased, and anything else separates words.

The dictionaries are learned from a bounded sample: per language, ``sample_docs`` distinct texts in
order of their hash, copies counting once, as much as fills ``dictionary_bytes``.  Of a text, pieces
spread from its start to its end give ``slice_bytes`` at most.  The dictionaries are a fixed size, and
the scoring is one pass without a shuffle.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and rejected;
languages without a letter in their sample are not learned; with no language learned, all is
``und``; ties go to the first language by name; repeated rows are judged each; other columns
pass through, and columns of the result's names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import quoted

DICTIONARY_BYTES = 48 << 10
SAMPLE_DOCS = 96
#: Bytes that one sampled text may give, and the pieces of it that give them in equal parts.
SLICE_BYTES, PIECES = 2048, 4
CHUNK_BYTES = 1024
LEVEL = 6
#: The smallest size must be this much below the second, as a share, or the text is rejected.
MIN_MARGIN = 0.003
UNKNOWN = "und"


def distinct_words(text: str) -> bytes:
    """The distinct words of letters, in order, one space between."""
    import regex

    return " ".join(dict.fromkeys(regex.findall(r"[\p{L}\p{M}]+", text.lower()))).encode()


def learn(
    docs: DataFrame, train: Column, text: str = "text", lang: str = "lang",
    dictionary_bytes: int = DICTIONARY_BYTES, sample_docs: int = SAMPLE_DOCS, slice_bytes: int = SLICE_BYTES,
) -> dict[str, bytes]:
    """{language: dictionary} from the rows where ``train`` holds.  The sample is on the driver."""
    rows = docs.where(train & quoted(text).isNotNull() & quoted(lang).isNotNull()).select(
        quoted(lang).cast("string").alias("lang"), F.xxhash64(quoted(text)).alias("h"), quoted(text).alias("t"))
    first = Window.partitionBy("lang").orderBy("h")
    keys = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_docs)
    # A row a sampled text: languages times sample_docs, so the keys and the sample stay small.
    chosen = rows.join(F.broadcast(keys), ["lang", "h"]).select("lang", "n", _pieces(F.col("t"), slice_bytes).alias("pieces"))
    sample = chosen.groupBy("lang", "n").agg(F.min("pieces").alias("pieces")).collect()
    parts: dict[str, list[bytes]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["n"])):
        if cleaned := _sliced(r["pieces"], slice_bytes):
            parts.setdefault(r["lang"], []).append(cleaned)
    return {k: b" ".join(v)[:dictionary_bytes] for k, v in sorted(parts.items())}


def _pieces(text: Column, slice_bytes: int) -> Column:
    """Pieces of ``slice_bytes`` characters each, evenly from the start of a text to its end."""
    spare = F.greatest(F.length(text) - slice_bytes, F.lit(0))
    starts = [F.floor(spare * (i / (PIECES - 1))).cast("int") + 1 for i in range(PIECES)]
    return F.array(*[F.substring(text, s, F.lit(slice_bytes)) for s in starts])


def _sliced(pieces: list[str], slice_bytes: int) -> bytes:
    """Distinct words of the pieces, each piece's share of the bytes; what one leaves, the next may use."""
    seen: dict[bytes, None] = {}
    used = 0
    for i, piece in enumerate(pieces, 1):
        for word in distinct_words(piece).split():
            word = word[: max(0, slice_bytes * i // len(pieces) - used)]
            if word and word not in seen:
                seen[word] = None
                used += len(word) + 1
    return b" ".join(seen)


class Sizer:
    """Compressed sizes of texts by language."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard

        self.languages = sorted(dictionaries)
        kind = zstandard.DICT_TYPE_RAWCONTENT
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
        self.compress = []
        for k in self.languages:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=kind)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the score is 1/2 at margin 0, and tends to 1."""
        data = distinct_words(text) if text else b""
        if not data or not self.languages:
            return UNKNOWN, 0.0, 0.0
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        sizes = [sum(len(c(x)) for x in chunks) for c in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.languages[best], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return self.languages[best], 1 / (1 + math.exp(-40 * margin)), margin


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, score, margin and rejected."""
    new = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("margin", T.DoubleType()), ("rejected", T.BooleanType())]
    names = {n for n, _ in new}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]
    keep = [f.name for f in kept]
    at = docs.columns.index(text)
    schema = T.StructType([*kept, *[T.StructField(n, kind) for n, kind in new]])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(shared.value)
        for batch in batches:
            found = [sizer.judge(x.as_py()) for x in batch.column(at)]
            rejected = [f[0] == UNKNOWN or f[2] < min_margin for f in found]
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n in keep]
            columns += [pa.array([f[0] for f in found], pa.string())]
            columns += [pa.array([f[i] for f in found], pa.float64()) for i in (1, 2)]
            columns += [pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
