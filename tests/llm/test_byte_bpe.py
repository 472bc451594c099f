"""Byte-level BPE against the tokenizer library that the ranks are for."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import byte_bpe
from plumbline.llm.queries import QUERIES
from tests.llm.fixtures import awkward, nothing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(reference, text):
    ids = reference.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_every_token_is_its_own_rank():
    tokens = byte_bpe.read_ranks(PATH)
    codec = byte_bpe.Codec(tokens, PATTERN)
    got = codec.processor.encode([t.decode("latin-1").translate(codec.table) for t in tokens], num_threads=1)
    assert got == [[i] for i in range(len(tokens))]


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "a" * 20_000, "▁ <unk> </s> <|endoftext|>", "日本語 テスト 😀", "\x00\x7f\x80", "don't I'll  we've"])
def test_codec(reference, text):
    codec = byte_bpe.Codec(byte_bpe.read_ranks(PATH), PATTERN)
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text) == codec.encode(text)
    assert codec.decode(ids) == text.encode()


def test_memory_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    codec = byte_bpe.Codec(byte_bpe.read_ranks(PATH), PATTERN)
    for text in ("many different words come here", "and others after them", "many different words come here"):
        assert codec.encode(text) == reference.encode_ordinary(text)
        assert len(codec.seen) <= 3 + 5


def test_query_equals_library(spark, sf_dir, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op1_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(reference, docs[r["doc_id"]])


def test_awkward_rows_and_round_trip(spark):
    docs = awkward(spark)
    out = byte_bpe.encode(docs, PATH, PATTERN)
    assert out.columns == [*docs.columns, "token_ids"] and out.count() == docs.count()
    for r in byte_bpe.decode(out, PATH).collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["score"] == "s"
    assert byte_bpe.encode(nothing(spark), PATH, PATTERN, digests=True).count() == 0
    again = byte_bpe.encode(out, PATH, PATTERN)  # an existing token_ids is replaced
    assert again.columns == out.columns


def test_remembered_ids_are_shared():
    codec = byte_bpe.Codec(byte_bpe.read_ranks(PATH), PATTERN)
    codec.encode("unheardofly quixotical zzyzxian words, words")
    assert codec.seen and all(i is codec.numbers[i] for ids in codec.seen.values() for i in ids)


def test_more_rows_than_a_worker_holds_at_a_time(spark, reference):
    n = 2 * byte_bpe.BATCH + 3
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id, ' of many') AS text").coalesce(1)
    out = byte_bpe.encode(docs, PATH, PATTERN, digests=True).collect()
    assert [r["doc_id"] for r in out] == list(range(n))
    for r in out:
        assert r["token_ids"] == reference.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["token_ids"])
