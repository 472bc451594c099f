"""Spelling variants of words, by edits looked up in broadcast Bloom filters.

Words are near if they differ by exactly one inserted, deleted or replaced character.  Every word of
the vocabulary makes its edits, each near pair from one side only: the longer word deletes, and of
two words of equal length the lesser replaces a character by a greater one.  An edit's hash follows
from the word's by arithmetic, so edits are hashed in arrays and no string is made of them.  The
hashes are looked up in Bloom filters of the vocabulary, one for each word length, in blocks of 512
bits with one bit in each of eight 64-bit words; what the first word rules out is not looked up in
the others.  Only edits that pass become strings and are joined with the vocabulary, where false
positives fall out; a filter has no false negatives, so the pairs are exact.

The filters are built by tasks, a bounded segment each, and broadcast; their size follows from the
number of words.  Beyond ``broadcast_bytes`` the vocabulary is cut by hash into as many slices as
keep a slice's filters within it, and the edits are made once for each slice, those of the slice
being looked up.  Words are distinct, and a word has a bounded number of edits, so there is no hot
key; occurrences are counted before they are shuffled.

Edge cases: a null or empty text has no words; a null id counts as an empty one; repeated rows count
each; very long words are worked on in parts; a table without words gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lower_ascii, quoted, stored

#: The characters of words once A-Z are lower-cased.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Filter bits a word, blocks of a segment that one task builds, and lengths that have a filter of their own.
BITS, SEGMENT, LENGTHS = 16, 1 << 14, 64
FILTER_BYTES = 32 << 20
#: Edits that are hashed at a time.
CELLS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_ALPHABET = np.array(sorted(map(ord, ALPHABET)), np.uint64)


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 31, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word): every occurrence of a run of letters of ``least_length`` or more once slips are made.

    Where ``every`` divides the CRC-32 of ``id:run``, the run loses the character at that hash
    modulo its length.
    """
    runs = F.regexp_extract_all(lower_ascii(quoted(text)), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), 0)
    rows = docs.select(F.coalesce(quoted(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    rows = rows.select("run", h.alias("h"), F.length("run").alias("n"))
    at = (F.col("h") % F.col("n")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("n")))
    word = F.when(F.col("h") % every == 0, slipped).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least_length)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n), from a row for each occurrence."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _MIX[0]
    h = (h ^ h >> np.uint64(33)) * _MIX[1]
    return h ^ h >> np.uint64(33)


def _coded(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.full(n, _STEP))).cumprod(dtype=np.uint64)


def hashes(words: list[str]) -> np.ndarray:
    """The unmixed hash of each word: the sum of character times power of place."""
    out = np.empty(len(words), np.uint64)
    for places in _by_length(words):
        coded = _coded([words[i] for i in places])
        out[places] = (coded * _powers(coded.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)
    return out


def _by_length(words: list[str]) -> list[np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else []


def _shard(length: int) -> int:
    return min(length, LENGTHS)


def _slice(mixed: np.ndarray, slices: int) -> np.ndarray:
    return (mixed & np.uint64(0xFFFF)) % np.uint64(slices)


def _places(mixed: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)


def _bit(mixed: np.ndarray, word: int) -> np.ndarray:
    """The bit in a block's word; all eight come from one hash mixed once more."""
    return (_mixed(mixed + np.uint64(1)) >> np.uint64(6 * word)) & np.uint64(63)


class Filter:
    """A blocked Bloom filter over mixed hashes."""

    def __init__(self, blocks: int, bits: np.ndarray | None = None) -> None:
        self.blocks, self.bits = blocks, np.zeros((blocks, 8), np.uint64) if bits is None else bits

    def holds(self, mixed: np.ndarray) -> np.ndarray:
        """Places in ``mixed`` of what may be in the set."""
        left, at = np.arange(len(mixed)), _places(mixed, self.blocks).astype(np.int64)
        rest = _mixed(mixed + np.uint64(1))
        for word in range(8):
            bit = rest >> np.uint64(6 * word) & np.uint64(63)
            passed = (self.bits[at, word] >> bit & np.uint64(1)).astype(bool)
            left, at, rest = left[passed], at[passed], rest[passed]
        return left


def blocks_of(words: int) -> int:
    return max(1, -(-words * BITS // 512))


def filters(vocab: DataFrame, sizes: dict[int, int], slice_: int, slices: int) -> dict[int, Filter]:
    """Filters by word length of one slice of the vocabulary; ``sizes`` has the blocks of each."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            mixed = _mixed(hashes(words))
            mine = np.flatnonzero(_slice(mixed, slices) == slice_)
            shard = np.array([_shard(len(words[i])) for i in mine], np.int32)
            mixed = mixed[mine]
            at = np.array([int(x) for x in _places(mixed, np.array([sizes[int(s)] for s in shard], np.uint64))], np.int64) if len(mine) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(at // SEGMENT), pa.array(mixed.view(np.int64))], names=["shard", "segment", "h"])

    def build(table: pa.Table) -> pa.Table:
        shard, segment = table["shard"][0].as_py(), table["segment"][0].as_py()
        mixed = np.array(table["h"]).view(np.uint64)
        first = segment * SEGMENT
        bits = np.zeros((min(SEGMENT, sizes[shard] - first), 8), np.uint64)
        at = _places(mixed, sizes[shard]).astype(np.int64) - first
        for word in range(8):
            np.bitwise_or.at(bits, (at, word), np.uint64(1) << _bit(mixed, word))
        return pa.table({"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    placed = vocab.select("word").mapInArrow(place, "shard int, segment bigint, h bigint")
    out: dict[int, Filter] = {}
    for row in placed.groupBy("shard", "segment").applyInArrow(build, "shard int, segment bigint, bits binary").toLocalIterator():
        whole = out.setdefault(row["shard"], Filter(sizes[row["shard"]]))
        got = np.frombuffer(row["bits"], "<u8").reshape(-1, 8)
        whole.bits[row["segment"] * SEGMENT : row["segment"] * SEGMENT + len(got)] = got
    return out


def edits(words: list[str], of: dict[int, Filter], slice_: int = 0, slices: int = 1) -> Iterator[tuple[int, str]]:
    """(place of a word, an edit of it) for the edits that pass the filters."""
    for places in _by_length(words):
        length = len(words[places[0]])
        same, shorter = of.get(_shard(length)), of.get(_shard(length - 1))
        powers = _powers(length)
        width = max(1, min(length, CELLS // len(_ALPHABET)))  # characters of a very long word at a time
        for i in range(0, len(places), max(1, CELLS // (length * len(_ALPHABET)))):
            part = places[i : i + max(1, CELLS // (length * len(_ALPHABET)))]
            texts = [words[p] for p in part]
            coded = _coded(texts)
            terms = coded * powers[:-1]
            total = terms.sum(axis=1, dtype=np.uint64)[:, None]
            if shorter is not None:
                before = np.cumsum(terms, axis=1, dtype=np.uint64)
                h = _mixed((before - terms + (total - before) * _BACK).ravel())
                # Of a run of one character only the first is deleted.
                first = np.concatenate((np.ones((len(part), 1), bool), coded[:, 1:] != coded[:, :-1]), axis=1).ravel()
                asked = np.flatnonzero(first & (_slice(h, slices) == slice_))
                for cell in asked[shorter.holds(h[asked])].tolist():
                    w, at = divmod(cell, length)
                    yield int(part[w]), texts[w][:at] + texts[w][at + 1 :]
            if same is not None:
                for at0 in range(0, length, width):
                    piece = coded[:, at0 : at0 + width]
                    steps = (_ALPHABET - piece[:, :, None]) * powers[at0 : at0 + piece.shape[1]][None, :, None]
                    greater = (_ALPHABET > piece[:, :, None]).ravel()
                    h = _mixed((total[:, :, None] + steps).ravel())
                    asked = np.flatnonzero(greater & (_slice(h, slices) == slice_))
                    for cell in asked[same.holds(h[asked])].tolist():
                        rest, letter = divmod(cell, len(_ALPHABET))
                        w, at = divmod(rest, piece.shape[1])
                        at += at0
                        yield int(part[w]), texts[w][:at] + chr(int(_ALPHABET[letter])) + texts[w][at + 1 :]


def near_words(vocab: DataFrame, broadcast_bytes: int = FILTER_BYTES) -> DataFrame:
    """(a, n, b, b_n): pairs of near words of ``vocab`` (word, n), each once."""
    spark = vocab.sparkSession
    counts = vocab.groupBy(F.least(F.length("word"), F.lit(LENGTHS)).alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()  # LENGTHS rows at most
    slices = max(1, -(-sum(blocks_of(r["n"]) * 64 for r in counts) // broadcast_bytes))
    # A slice's share of the words differs by chance from the others', so it gets a few blocks more.
    sizes = {r["shard"]: blocks_of(r["n"] // slices + 1) for r in counts}
    found = None
    for slice_ in range(slices):
        shared = spark.sparkContext.broadcast({k: (f.blocks, f.bits) for k, f in filters(vocab, sizes, slice_, slices).items()})

        def probe(batches: Iterator[pa.RecordBatch], shared=shared, slice_=slice_) -> Iterator[pa.RecordBatch]:
            of = {k: Filter(*x) for k, x in shared.value.items()}
            for b in batches:
                hits = list(edits(b.column(0).to_pylist(), of, slice_, slices))
                at = pa.array([p for p, _ in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([e for _, e in hits], pa.string())], names=["a", "n", "b"])

        passed = vocab.select("word", "n").mapInArrow(probe, "a string, n bigint, b string")
        found = passed if found is None else found.unionByName(passed)
    return found.join(vocab.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").select("a", "n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form), form followed to the last; a form's own count is at least RATIO times as large, so there is no circle."""
    now = stored(forms.select("word", F.col("form").alias("to")), "variant-roots")
    while True:
        further = now.select(F.col("word").alias("to"), F.col("to").alias("next"))
        now = stored(now.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", F.col("to").alias("root"))
        now = now.drop("moved")


def variants(vocab: DataFrame, ratio: int = RATIO, broadcast_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``vocab`` (word, n).

    A word's form is its near word of largest n (ties: the least in code-point order), if that is at
    least ``ratio`` times the word's own.
    """
    vocab = stored(vocab, "variant-words")
    pairs = stored(near_words(vocab, broadcast_bytes), "variant-pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near")).alias("x")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("a").alias("near")).alias("x")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("x").alias("x"))
    rows = vocab.join(best, "word", "left")
    taken = -F.col("x.less") >= ratio * F.col("n")
    rows = stored(rows.select(
        "word", F.when(taken, F.col("x.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(taken, -F.col("x.less")).alias("form_n")), "variant-forms")
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of whole texts."""
    return variants(vocabulary(occurrences(docs, doc_id, text)))
