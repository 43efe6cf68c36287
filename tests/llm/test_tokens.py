"""Operators 1, 3 and 8 against the libraries."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from .conftest import clashing
from tokenizers import Tokenizer
from turnstone.llm.pieces import PieceEncoder
from turnstone.llm.token_counts import token_counts
from turnstone.llm.token_files import TokenFile, read_documents, write_tokens
from turnstone.llm.tree_bpe import MonoidBpe, MonoidDecoder, encode_decode, ranks_of

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_agree_with_tiktoken(tik):
    rng = random.Random(1)
    letters = list("abs tremvld'' \n\t12 .,;-é 　漢²½Ⅷ_\x1c\x85́😀<|>͸﻿​")
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(5000)]
    e = PieceEncoder(lambda pieces: [tik.encode_ordinary(p) for p in pieces], most=500)  # forgets often
    assert [x.tolist() for x in e.ids(texts)] == [tik.encode_ordinary(t) for t in texts]
    assert e.counts(texts).tolist() == [len(tik.encode_ordinary(t)) for t in texts]


def test_monoid_is_the_encoding(tik):
    bpe = MonoidBpe(ranks_of(open(RANKS, "rb").read()))
    rng = random.Random(2)
    for _ in range(20_000):
        piece = "".join(rng.choices("etaoinshrdlucmfwyp ETA'é0123"[: rng.choice([5, 12, 28])], k=rng.randrange(1, 24))).encode()
        whole = tik._core_bpe.encode_single_piece(piece)
        assert list(bpe.encode(piece)) == whole
        cut = rng.randrange(len(piece) + 1)
        assert bpe.join(bpe.encode(piece[:cut]), bpe.encode(piece[cut:])) == tuple(whole)
    assert bpe.join((), bpe.encode(b"x")) == bpe.encode(b"x") and bpe.encode(b"") == ()


def test_decoder_is_the_inverse(tik):
    bpe = MonoidBpe(ranks_of(open(RANKS, "rb").read()))
    decoder = MonoidDecoder(bpe.bytes_of)
    ids = np.array(tik.encode_ordinary("Some text, again and again. " * 40_000))
    assert decoder.decode(ids) == tik.decode_bytes(ids.tolist()) and decoder.decode(ids[:0]) == b""


def test_token_counts(spark, docs, texts, library, empty_docs, tmp_path):
    both = clashing(docs.union(docs.limit(3)))
    rows = token_counts(both, JSON, str(tmp_path / "cache")).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library(t))) and r.over_limit == (r.n_tokens > 1024)
    cached = spark.read.parquet(str(tmp_path / "cache"))
    distinct = len({t or "" for t in texts})
    assert cached.count() >= distinct and cached.select("digest").distinct().count() == distinct
    before = cached.count()
    assert token_counts(docs, JSON, str(tmp_path / "cache")).count() == len(texts)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == before  # nothing was encoded again
    assert token_counts(empty_docs, JSON).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in token_counts(nulls, JSON).collect()) == [0, 2, 2]


def test_token_files(spark, docs, texts, library, empty_docs, tmp_path):
    manifest = write_tokens(clashing(docs), f"file://{tmp_path}/out", JSON, length=64, shards=3)
    got = {r.doc_id: r for r in read_documents(manifest).collect()}
    start = 0
    stream = []
    for i, t in enumerate(texts):
        ids = [*library(t), 0]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
        stream += ids
    read = []
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        f = TokenFile(r.path)
        ids, mask = f.sequence(0, 1 if len(f) > 1 else 0)
        assert len(ids) == 64 and not ids.flags.owndata and len(mask) == 64  # a view of the file
        for ids, _ in f.stream():
            read += ids.tolist()
    assert read == stream
    assert read_documents(write_tokens(empty_docs, f"file://{tmp_path}/none", JSON)).count() == 0
    nulls = spark.createDataFrame([(None, "b"), (1, "x"), (1, "x"), (None, None)], "doc_id long, text string")
    out = sorted(read_documents(write_tokens(nulls, f"file://{tmp_path}/nulls", JSON)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, None, 1, 1] and [r.start for r in out][-1] == sum(r.n_tokens for r in out[:-1])


def test_unknown_code_points_are_cut_by_the_pattern(spark, tik):
    odd = "\u0378\uffff\U0010ffff\U0003fffe\U000105c0\U00010d40\U0001fae9\U00011bc0\U00016d70\ua7cb"
    rng = random.Random(7)
    texts = ["A line.\n\nThe next one. Indented\n    code here \u0378", "\U0010ffff", "a\U0010ffff\n\n  b", *odd]
    texts += ["".join(rng.choices([*odd, *"abs1 \n\t'.é", "\n\n   ", " the", "'s", "12"], k=rng.randrange(40))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in encode_decode(df, RANKS, with_ids=True).collect():
        assert list(r.ids) == tik.encode_ordinary(texts[r.doc_id]), texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encode_decode(spark, docs, texts, tik, empty_docs):
    rows = encode_decode(clashing(docs.union(docs.limit(2))), RANKS, with_ids=True).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        ids = tik.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and list(r.ids) == ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert encode_decode(empty_docs, RANKS).count() == 0
    assert encode_decode(spark.createDataFrame([(None, "x")], "doc_id long, text string"), RANKS).first().doc_id is None


def thue_morse(n):
    """Two words of n letters whose polynomial hashes modulo 2**64 are equal for any odd multiplier."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_pieces_of_one_hash_are_told_apart(spark, tik, library, n):
    words = thue_morse(n)
    for texts in (words, words[::-1], (words[0], f"{words[1]} {words[0]}", words[1])):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        assert [list(r.ids) for r in encode_decode(df, RANKS, with_ids=True).orderBy("doc_id").collect()] == [tik.encode_ordinary(t) for t in texts]
        assert [r.n_tokens for r in token_counts(df, JSON).orderBy("doc_id").collect()] == [len(library(t)) for t in texts]


@pytest.mark.parametrize("part", ["=", " ", "\n", "7", "a", "=-=", "1234567"])
def test_long_pieces_are_quick(tik, part):
    bpe = MonoidBpe(ranks_of(open(RANKS, "rb").read()))
    data = (part * (1_000_003 // len(part))).encode()
    began = time.time()
    ids = bpe.encode(data)
    assert time.time() - began < 10 and list(ids) == tik._core_bpe.encode_single_piece(data)


def test_merges_by_heap_and_by_list(tik):
    bpe = MonoidBpe(ranks_of(open(RANKS, "rb").read()))
    rng = random.Random(12)
    for _ in range(3000):
        data = "".join(rng.choices("etaoin ab="[: rng.choice([2, 5, 10])], k=rng.randrange(1, 90))).encode()
        assert list(bpe._merged(data)) == list(bpe._merged_by_heap(data)) == list(bpe.encode(data)) == tik._core_bpe.encode_single_piece(data)
