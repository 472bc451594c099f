"""Language-model scores from sharded Elias-Fano tries of pairs and of trigrams.

The model: a word's probability after another is (count of the pair + MU * the word's own
probability) / (count of the first + MU), and a word's own is the smoothed unigram share.  With
``order`` 3 (the default) a word after two others has (count of the three + MU_TOP * its
probability after the nearer one) / (count of the two + MU_TOP); a text's first word has no second
word before it and stays at order 2.  The tries hold the counts in training of pairs and trigrams,
as quantised logarithms; the weight of the lower order follows from the count of the context, so
no shard needs the words' totals, and what it sends back is a few small numbers many times over.

The corpus is worked on in blocks of a few million tokens, each with a dictionary of its own:

1. documents are cut and coded into blocks, written once to the shared folder, bucketed by block,
   so that what comes back to the blocks is joined without moving them;
2. each block sends its words' counts to shards by word; a shard adds them up over all blocks,
   numbers the words, and sends numbers and totals back;
3. each block sends its distinct pairs and what follows each, with their counts in training, to
   shards by pair; a shard adds them up, builds its tries, writes them to a file, maps that into
   memory, looks every block's pairs and trigrams up in it, and sends what it finds back;
4. each block smooths the counts and adds up its tokens' scores by document.

All arrays that move are packed, so a shuffle has one row for each (block, shard).  Shards are by
hash, and their number follows the data, so that one holds a bounded number of entries; of a
frequent word or pair each block sends one entry.  What follows a heavy pair (a shard's worth of
tokens or more) is spread over the shards by trigram; such pairs are counted first (``heavy``),
and their totals go along.  There are at most HEAVY_PAIRS of them at any size, as the bound is no
less than that share of all tokens.  Nothing but totals and heavy pairs is on the driver.  The
file of a shard's tries is a temporary one of the task, which a lost executor's rerun writes anew;
``gram_scores`` with ``keep`` leaves them in its result too (``tries``).

Edge cases: a null or empty text is its end token alone; rows whose ``train`` is null are not
learned from; with nothing to learn from, base scores are those of N = V = 0 and the score
equals the base score; words are told apart by a 64-bit hash; repeated rows count each; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import io
import mmap
import os
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import quoted, stored
from plumbline.llm.elias_fano import Trie
from plumbline.session import shared_folder

BLOCK_TOKENS = 2_000_000
#: Dictionary entries of a word shard, and tokens of a pair shard, about.
SHARD_WORDS, SHARD_TOKENS = 1_000_000, 2_000_000
LEAST_SHARDS = 12
MU, MU_TOP = 50.0, 5.0
#: Pairs that can be heavy, at most.
HEAVY_PAIRS = 1 << 20
ADD = 0.1
END = b""  # hashed for the end token; no word is empty

_MOVED = "block bigint, shard int, kind int, payload binary, v bigint, n bigint"
_MOVED_ARROW = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary()), ("v", pa.int64()), ("n", pa.int64())])
WORDS, PAIRS, TRIE = 0, 1, 2


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; bytes of the same place side by side, which compress better."""
    import zstandard

    out = io.BytesIO()
    np.savez(out, **{f"{k}:{v.dtype.str}": np.ascontiguousarray(v).view(np.uint8).reshape(-1, v.itemsize).T.copy() for k, v in arrays.items()})
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    found = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data)), allow_pickle=False)
    return {k.split(":")[0]: np.ascontiguousarray(found[k].T).view(k.split(":")[1]).ravel() for k in found.files}


def _slim(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _steps(x: np.ndarray) -> np.ndarray:
    """A sorted array as its first element and the steps from there."""
    return _slim(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


class _Block:
    """Documents being coded."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.words[END]
        self.tokens: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.ids: list = []
        self.train: list[bool] = []
        self.n = 0

    def add(self, key, text: str | None, train: bool) -> None:
        words = (text or "").encode().lower().split()
        ids = np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words))
        self.tokens += [ids, np.zeros(1, np.uint32)]
        self.lengths.append(len(words) + 1)
        self.ids.append(key)
        self.train.append(train)
        self.n += len(words) + 1

    def row(self, number: int, kind: pa.DataType) -> list[pa.Array]:
        import xxhash

        tokens, lengths, train = np.concatenate(self.tokens), np.array(self.lengths), np.array(self.train)
        hashes, place = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words)), return_inverse=True)
        counts = np.bincount(place[tokens[np.repeat(train, lengths)]], minlength=len(hashes))
        words, payload = pack(h=hashes, c=_slim(counts)), pack(t=_slim(tokens), p=_slim(place), l=_slim(lengths), train=train)
        return [
            pa.array([number], pa.int64()), pa.array([self.ids], pa.list_(kind)), pa.array([words], pa.binary()), pa.array([payload], pa.binary()),
            pa.array([len(hashes)], pa.int64()), pa.array([self.n], pa.int64())]


def code(docs: DataFrame, train: Column, doc_id: str, text: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Step 1: (block, ids, words, payload, n_words, n_tokens); words in order of their hashes."""
    rows = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
        T.StructField("words", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block, kind = TaskContext.get().partitionId() << 20, _Block(), None
        give = lambda: pa.RecordBatch.from_arrays(block.row(number, kind), names=schema.names)
        for b in batches:
            kind = b.column(0).type
            for key, text_, learn in zip(b.column(0), b.column(1), b.column(2)):
                block.add(key.as_py(), text_.as_py(), learn.as_py())
                if block.n >= block_tokens:
                    yield give()
                    number, block = number + 1, _Block()
        if block.ids:
            yield give()

    spark, name = docs.sparkSession, f"lm_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.mapInArrow(run, schema).write.format("parquet").option("compression", "none").option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def _moved(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MOVED_ARROW)], schema=_MOVED_ARROW)


def _word_shards(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash, so that a block's words of one shard are side by side."""
    return (h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def _mixed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two numbers."""
    x = (one * np.uint64(0x9E3779B97F4A7C15) + two + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)


def _shard(hashed: np.ndarray, shards: int) -> np.ndarray:
    return (hashed >> np.uint64(40)) % np.uint64(shards)


def word_totals(blocks: DataFrame, shards: int) -> DataFrame:
    """Step 2: for each (block, shard) the block's words' numbers and totals, and v and n of the shard.

    A word's number is its shard, times 2 ** 32, plus its place there: in order of the hash.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words in zip(b.column(0).to_pylist(), b.column(1)):
                x = unpack(words.as_py())
                ends = np.searchsorted(_word_shards(x["h"], shards), np.arange(shards + 1, dtype=np.uint64))
                for s in range(shards):
                    if ends[s] < ends[s + 1]:
                        part = slice(ends[s], ends[s + 1])
                        yield from _moved([(block, s, WORDS, pack(h=x["h"][part], c=x["c"][part]), 0, 0)]).to_batches()

    def add(table: pa.Table) -> pa.Table:
        got = [unpack(p.as_py()) for p in table["payload"]]
        h, inverse = np.unique(np.concatenate([x["h"] for x in got]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([x["c"] for x in got]), len(h)).astype(np.uint64)
        shard = table["shard"][0].as_py()
        v, n = int((total > 0).sum()), int(total.sum())
        parts = np.split(inverse, np.cumsum([len(x["h"]) for x in got])[:-1])
        return _moved([
            (block, shard, WORDS, pack(c=_slim(total[p]), g=_steps(p)), v if i == 0 else 0, n if i == 0 else 0)
            for i, (block, p) in enumerate(zip(table["block"].to_pylist(), parts))])

    sent = blocks.select("block", "words").mapInArrow(send, _MOVED)
    return stored(sent.groupBy("shard").applyInArrow(add, _MOVED), "lm-words")


def _numbered(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The block's words' numbers and totals, put together from the shards'."""
    rows = sorted(zip(answers["shard"].to_pylist(), answers["payload"].to_pylist()))
    parts = [(shard, unpack(p)) for shard, p in rows]
    numbers = np.concatenate([_sums(x["g"]) + np.uint64(shard << 32) for shard, x in parts])
    return numbers, np.concatenate([x["c"].astype(np.uint64) for _, x in parts])


def _log_own(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((c + ADD) / (n + ADD * (v + 1)))


def _firsts(place: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The word before each token: a text's first word follows the end token, the block's first word."""
    return np.concatenate((place[:1], second[:-1]))


class Heavy:
    """Hashes and training counts of the heavy pairs, in order of the hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """The count of each that is heavy, else 0."""
        if not len(self.hashes):
            return np.zeros(len(hashed), np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashed, self.counts[at], np.uint64(0))


def heavy(blocks: DataFrame, words: DataFrame, least: int) -> Heavy:
    """Pairs that occur ``least`` times or more in training; only pairs of words that do are looked at."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        x, (numbers, totals) = unpack(left["payload"][0].as_py()), _numbered(right)
        place = x["p"].astype(np.int64)
        second = place[x["t"]]
        first = _firsts(place, second)
        often = totals >= least
        found = np.flatnonzero(often[first] & often[second] & np.repeat(x["train"], x["l"]))
        hashed, n = np.unique(_mixed(numbers[first[found]], numbers[second[found]]), return_counts=True)
        return pa.table({"pair": hashed.view(np.int64), "n": n.astype(np.int64)})

    sent = blocks.select("block", "payload").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(send, "pair bigint, n bigint")
    found = sent.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    return Heavy(np.array(found["pair"], np.int64).view(np.uint64), np.array(found["n"], np.int64).astype(np.uint64))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and each key's place among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], place


class _Requests:
    """A block's distinct pairs and trigrams, in the order in which the shards are asked.

    An entry is a pair at a shard: its own, and for a heavy pair those of its trigrams.
    """

    def __init__(self, x: dict, numbers: np.ndarray, shards: int, order: int, heavy_: Heavy) -> None:
        low, wide = np.uint64(0xFFFFFFFF), np.uint64(32)
        second = x["p"].astype(np.uint64)[x["t"]]
        distinct, self.pair = _distinct(_firsts(x["p"].astype(np.uint64), second) << wide | second)
        one, two = (distinct >> wide).astype(np.int32), (distinct & low).astype(np.int32)
        hashed = _mixed(numbers[one], numbers[two])
        del distinct
        of = _slim(_shard(hashed, shards))
        train = np.repeat(x["train"], x["l"])
        self.at = self.which = context = third = np.empty(0, np.int32)
        if order == 3:
            inner = np.ones(len(second), bool)
            inner[np.cumsum(x["l"].astype(np.int64))[:-1]] = inner[:1] = False
            self.at = np.flatnonzero(inner).astype(np.int32)  # tokens that are not a text's first
            tri, self.which = _distinct(self.pair[self.at - 1].astype(np.uint64) << wide | second[self.at])
            context, third = (tri >> wide).astype(np.int32), (tri & low).astype(np.int32)
            del tri, inner
        del second
        spread = np.flatnonzero((heavy_.find(hashed) > 0)[context])
        by_trigram = _shard(_mixed(hashed[context[spread]], numbers[third[spread]]), shards) << wide | context[spread].astype(np.uint64)
        guests = np.unique(by_trigram)
        guests = guests[of[(guests & low).astype(np.int64)] != guests >> wide]
        sorted_ = np.argsort(of, kind="stable")
        entries = of[sorted_].astype(np.uint64) << wide | sorted_.astype(np.uint64)
        later = np.arange(len(entries)) + np.searchsorted(guests, entries)
        self.own = np.empty(len(entries), np.int32)
        self.own[sorted_] = later
        asked = self.own[context]
        entries = np.insert(entries, np.searchsorted(entries, guests), guests)
        asked[spread] = np.searchsorted(entries, by_trigram)
        entry = (entries & low).astype(np.int32)
        self.one, self.two = one[entry], two[entry]
        self.learned = np.zeros(len(entries), np.int32)
        self.learned[self.own] = np.bincount(self.pair[train], minlength=len(one))
        turn = np.argsort(asked, kind="stable")
        back = np.empty(len(turn), np.int32)
        back[turn] = np.arange(len(turn))
        self.which, self.third, self.context = back[self.which], third[turn], asked[turn]
        self.learned_top = np.bincount(self.which[train[self.at]], minlength=len(turn)).astype(np.int32)
        self.followers = np.bincount(self.context, minlength=len(entries)).astype(np.int32)
        self.ends = np.searchsorted(entries >> wide, np.arange(shards + 1, dtype=np.uint64))
        self.ends_top = np.concatenate(([0], np.cumsum(self.followers)))[self.ends]

    def parts(self) -> Iterator[tuple[int, slice, slice]]:
        """(shard, entries, trigrams) of the shards that are asked."""
        for s in range(len(self.ends) - 1):
            if self.ends[s] < self.ends[s + 1]:
                yield s, slice(self.ends[s], self.ends[s + 1]), slice(self.ends_top[s], self.ends_top[s + 1])


def _found(trie: Trie, place: np.ndarray) -> np.ndarray:
    """The codes, from 1, of what lies at these places, 0 for no place."""
    out = np.zeros(len(place), "<u2")
    out[place >= 0] = trie.codes[place[place >= 0]] + np.uint16(1)
    return out


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes as ranks among their distinct values, and these."""
    there = np.zeros(1 << 16, bool)
    there[codes] = True
    return _slim((np.cumsum(there) - 1)[codes]), np.flatnonzero(there).astype("<u2")


def _counts(ranks: np.ndarray, codes: np.ndarray, low: float, step: float) -> np.ndarray:
    """What was counted, of ranked codes; up to some thousands exactly."""
    return np.where(codes > 0, np.rint(10 ** (low + step * (codes - 1.0))), 0.0)[ranks]


def _mapped(parts: list[bytes]) -> Iterator[Trie]:
    """Tries over a memory-mapped file of them, one at a time."""
    with tempfile.TemporaryFile() as f:
        f.write(b"".join(parts))
        f.flush()
        with mmap.mmap(f.fileno(), os.fstat(f.fileno()).st_size, access=mmap.ACCESS_READ) as mapped:
            view, at = memoryview(mapped), 0
            for part in parts:
                inner = view[at : at + len(part)]
                yield Trie(inner)
                inner.release()
                at += len(part)
            view.release()


def gram_scores(blocks: DataFrame, words: DataFrame, n: int, v: int, shards: int, order: int, heavy_: Heavy, keep: bool = False) -> DataFrame:
    """Step 3: for each (block, shard) the quantised counts of its pairs and trigrams; the tries with ``keep``.

    Counts do not depend on ``n`` and ``v``, the words' tokens and types in training.
    """

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        x, (numbers, _) = unpack(left["payload"][0].as_py()), _numbered(right)
        r, rows = _Requests(x, numbers, shards, order, heavy_), []
        for s, part, top in r.parts():
            used, at = np.unique(np.concatenate((r.one[part], r.two[part], r.third[top])), return_inverse=True)
            size = part.stop - part.start
            rows.append((left["block"][0].as_py(), s, PAIRS, pack(
                w=_steps(numbers[used]), a=_steps(at[:size]), b=_slim(at[size : 2 * size]), n=_slim(r.learned[part]),
                k=_slim(r.followers[part]), d=_slim(at[2 * size :]), m=_slim(r.learned_top[top])), 0, 0))
        return _moved(rows)

    def answer(table: pa.Table) -> pa.Table:
        got = [unpack(p.as_py()) for p in table["payload"]]
        words_, inverse = np.unique(np.concatenate([_sums(x["w"]) for x in got]), return_inverse=True)
        starts = np.cumsum([0, *[len(x["w"]) for x in got]])
        word = lambda s, part: inverse[s + part.astype(np.int64)].astype(np.uint64)
        keys = [word(s, _sums(x["a"])) << np.uint64(32) | word(s, x["b"]) for s, x in zip(starts, got)]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(back, np.concatenate([x["n"] for x in got]), len(distinct))
        parts = np.split(back, np.cumsum([len(k) for k in keys])[:-1])
        keys = [np.repeat(p, x["k"]).astype(np.uint64) << np.uint64(32) | word(s, x["d"]) for s, p, x in zip(starts, parts, got)]
        tops, back = np.unique(np.concatenate(keys), return_inverse=True)
        counts_top = np.bincount(back, np.concatenate([x["m"] for x in got]), len(tops))
        parts_top = np.split(back, np.cumsum([len(k) for k in keys])[:-1])
        del got, keys, inverse, back
        one, two = (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
        learned, contexts = counts > 0, np.unique(one[counts > 0])
        data = [Trie.encode(words_, one[learned], two[learned], np.log10(counts[learned]), contexts, np.zeros(len(contexts)))]
        if order == 3:  # the pairs, as contexts, have the numbers after those of the words
            context, third = (tops >> np.uint64(32)).astype(np.int64), (tops & np.uint64(0xFFFFFFFF)).astype(np.int64)
            numbers = np.concatenate((words_, words_[-1:] + np.uint64(1) + np.arange(len(distinct), dtype=np.uint64)))
            seen, w = counts_top > 0, len(words_)
            contexts = np.unique(context[seen])
            data.append(Trie.encode(numbers, w + context[seen], third[seen], np.log10(counts_top[seen]), w + contexts, np.zeros(len(contexts))))
        levels = _mapped(data)
        trie = next(levels)
        codes, scale = _found(trie, trie.places(words_, one, two)[0]), trie.scale[:2]
        codes_top, scale_top = np.zeros(len(tops), "<u2"), [0.0, 0.0]
        if order == 3:
            trie = next(levels)
            codes_top, scale_top = _found(trie, trie.places(numbers, w + context, third)[0]), trie.scale[:2]
        del trie
        next(levels, None)
        shard, rows = table["shard"][0].as_py(), []
        for block, part, top in zip(table["block"].to_pylist(), parts, parts_top):
            (p, of_p), (d, of_d) = _ranked(codes[part]), _ranked(codes_top[top])
            rows.append((block, shard, PAIRS, pack(p=p, u=of_p, d=d, t=of_d, q=np.array([*scale, *scale_top])), 0, 0))
        return _moved(rows + [(-1, shard, TRIE, level, i, 0) for i, level in enumerate(data, 2) if keep])

    sent = blocks.select("block", "payload").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(send, _MOVED)
    answers = sent.groupBy("shard").applyInArrow(answer, _MOVED)
    return stored(answers, "lm-grams") if keep else answers  # read once, so the shuffle to the blocks is copy enough


def tries(answers: DataFrame) -> DataFrame:
    """(shard, order, payload): the model's shards, a level each, of answers that keep them."""
    return answers.where(F.col("kind") == TRIE).select("shard", F.col("v").alias("order"), "payload")


def score(
    docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS,
    shard_words: int = SHARD_WORDS, shard_tokens: int = SHARD_TOKENS, order: int = 3,
) -> DataFrame:
    """Learns from the rows where ``train`` holds, and scores all rows by a model of ``order`` 2 or 3.

    One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    blocks = code(docs, train, doc_id, text, block_tokens)
    size = blocks.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t")).first()
    words = word_totals(blocks, max(LEAST_SHARDS, -(-(size["w"] or 0) // shard_words)))
    total = words.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    v, n = total["v"] or 0, total["n"] or 0
    pair_shards = max(LEAST_SHARDS, -(-(size["t"] or 0) // shard_tokens))
    least = max(shard_tokens, -(-n // HEAVY_PAIRS))
    none = np.empty(0, np.uint64)
    heavy_ = heavy(blocks, words, least) if order == 3 and n >= least else Heavy(none, none)
    pairs = gram_scores(blocks, words, n, v, pair_shards, order, heavy_).where(F.col("kind") == PAIRS)
    schema = T.StructType([
        T.StructField("id", blocks.schema["ids"].dataType.elementType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = np.array(right["kind"])
        x, (numbers, totals) = unpack(left["payload"][0].as_py()), _numbered(right.filter(pa.array(kinds == WORDS)))
        r = _Requests(x, numbers, pair_shards, order, heavy_)
        counts, counts_top = np.zeros(len(r.one)), np.zeros(len(r.third))
        answers = right.filter(pa.array(kinds == PAIRS))
        asked = {s: (part, top) for s, part, top in r.parts()}
        for s, payload in zip(answers["shard"].to_pylist(), answers["payload"]):
            y, (part, top) = unpack(payload.as_py()), asked[s]
            counts[part], counts_top[top] = _counts(y["p"], y["u"], *y["q"][:2]), _counts(y["d"], y["t"], *y["q"][2:])
        counts, log_own = counts[r.own], _log_own(totals, n, v)
        p = (counts + MU * 10 ** log_own[r.two[r.own]]) / (totals[r.one[r.own]] + MU)
        log_p = np.log10(p)[r.pair]
        log_p[r.at] = np.log10((counts_top[r.which] + MU_TOP * p[r.pair[r.at]]) / (counts[r.pair[r.at - 1]] + MU_TOP))
        own, lengths = totals[x["p"]], x["l"].astype(np.int64)  # by the block's own codes
        at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        add = lambda values: pa.array(np.add.reduceat(values, at))
        return pa.Table.from_arrays([
            left["ids"].combine_chunks().flatten(), pa.array(lengths), add((own > 0).astype(np.int64)[x["t"]]), pa.array(np.full(len(lengths), n, np.int64)),
            add(log_own[x["p"]][x["t"]]), add(log_p)], names=schema.names)

    back = words.unionByName(pairs).groupBy("block")
    return blocks.select("block", "ids", "payload").groupBy("block").cogroup(back).applyInArrow(finish, schema)
