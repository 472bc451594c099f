"""Byte-level BPE encoding and decoding with a sentencepiece model made from the vocabulary.

The model is serialised directly, with no training: every token's bytes are mapped to one
printable character each, the piece's score is its negative rank, and the normaliser is the
identity without white-space handling.  A piece's id is its rank.  Sentencepiece then merges the
pair with the lowest rank first, from the left, which is what the ranks mean.  The text is cut
by the tokenizer's pattern; the pre-tokens are encoded one by one, through a bounded memory of
those seen before.  Decoding maps ids to their bytes.

The model is a few MB, fixed by the vocabulary file, and is shipped to the tasks.  The work is
one pass over the documents without a shuffle.

Edge cases: a null text is encoded as empty; lone surrogates cannot occur in a Spark string;
a pre-token of any length is encoded whole; repeated rows are encoded each; an empty table
gives no rows; other columns are not touched, and columns of the result's names are replaced.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pre-tokens up to this many characters are remembered, about so many of them.
REMEMBERED_LENGTH, REMEMBERED = 32, 150_000
#: Rows whose ids a Python worker holds at a time.
BATCH = 256


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {}, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(0x100 + n)
            n += 1
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 and rank per line), by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, value) -> bytes:
    """A protocol-buffer field: int, float, bytes or str."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks of ``tokens``."""
    chars = byte_characters()
    unknown = len(tokens)
    # Field numbers of sentencepiece_model.proto: pieces 1 (piece 1, score 2, type 3), trainer
    # 2 (model_type 3 = BPE 2, vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43),
    # normalizer 3 (name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5).
    out = [
        _field(1, _field(1, "".join(chars[b] for b in t)) + _field(2, float(-rank)) + _field(3, 1))
        for rank, t in enumerate(tokens)
    ]
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = 2**64 - 1  # -1
    out.append(_field(2, _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + b"".join(_field(i, none) for i in (41, 42, 43))))
    out.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes | None = None) -> None:
        import regex
        import sentencepiece

        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model or serialise_model(tokens))
        self.table = dict(enumerate(byte_characters()))
        self.seen: dict[str, tuple[int, ...]] = {}
        #: One object for each id, shared by all that is remembered.
        self.numbers = list(range(len(tokens) + 1))
        #: Tokens that merging does not reach, but which a pre-token can be as a whole.
        self.whole = dict(zip(tokens, self.numbers))

    def encode(self, text: str) -> list[int]:
        """The ids of all pre-tokens; those not seen before are encoded in one call."""
        cut = self.find(text)
        seen = self.seen
        new = list(set(cut).difference(seen))
        if new:
            raw = [p.encode() for p in new]
            got = self.processor.encode([r.decode("latin-1").translate(self.table) for r in raw], num_threads=1)
            # A pre-token that is a token as a whole is that token, however the merges go.
            number = self.numbers.__getitem__
            seen.update((p, (self.whole[r],) if r in self.whole else tuple(map(number, g))) for p, r, g in zip(new, raw, got, strict=True))
        ids = list(chain.from_iterable(map(seen.__getitem__, cut)))
        if len(seen) > REMEMBERED:
            seen.clear()
        for p in new:
            if len(p) > REMEMBERED_LENGTH:
                seen.pop(p, None)
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(tokens: tuple[bytes, ...], pattern: str) -> Codec:
    return Codec(list(tokens), pattern)


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str | None = "token_ids",
    digests: bool = False, keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with column ``ids``, array<int>, after the others.

    With ``digests``: n_tokens, ids_sha256 (decimal ids joined by one space), and
    decoded_sha256 (the bytes that the ids decode to).
    """
    import hashlib

    tokens = tuple(read_ranks(path))
    shared = docs.sparkSession.sparkContext.broadcast((tokens, pattern))
    new = [(ids, T.ArrayType(T.IntegerType(), False))] if ids else []
    if digests:
        new += [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    names = {n.lower() for n, _ in new}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]
    keep = [f.name for f in kept]
    at = docs.columns.index(text)
    schema = T.StructType([*kept, *[T.StructField(n, kind) for n, kind in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*shared.value)
        number = [str(i) for i in range(len(c.tokens))].__getitem__
        pa.default_memory_pool().release_unused()  # of the stages before this one
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                flat, counts, hashes, decoded = [], [], [], []
                for value in batch.column(at):
                    found = c.encode(value.as_py() or "")
                    counts.append(len(found))
                    if ids:
                        flat.append(np.array(found, np.int32))
                    if digests:
                        hashes.append(hashlib.sha256(" ".join(map(number, found)).encode()).hexdigest())
                        decoded.append(hashlib.sha256(c.decode(found)).hexdigest())
                columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n in keep]
                if ids:
                    columns.append(pa.ListArray.from_arrays(np.cumsum([0, *counts], dtype=np.int32), np.concatenate(flat)))
                columns += [pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)] if digests else []
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the bytes (binary) of its ids; null ids give null."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = [f for f in encoded.schema.fields if f.name.lower() != out.lower()]
    keep = [f.name for f in kept]
    at = encoded.columns.index(ids)
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = tokens.value.__getitem__
        for batch in batches:
            made = [None if x.as_py() is None else b"".join(map(get, x.as_py())) for x in batch.column(at)]
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.binary())], names=[f.name for f in schema.fields])

    return encoded.mapInArrow(run, schema)
