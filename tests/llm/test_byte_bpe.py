"""Operator 13 against the library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tests.llm.test_operators import SF, odd_docs

from wrenchlake.llm import byte_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(RANKS, "rb") as file:
        ranks = byte_bpe.parse_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.ByteCodec(ranks, public_tokenizers.PATTERN), library


def row(library, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def test_random_texts(both):
    codec, library = both
    rng = random.Random(3)
    for letters in ("aaabcdeé 'srtlm\n\t 日本12٣!?_-\x1c\x85　ß😀", "abe'st ", "the ingtion", " \n\t\r", "01 .,", "éàüñ ç"):
        for _ in range(1500):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
            n, ids, decoded = codec.coded(text)
            assert ids == " ".join(map(str, library.encode_ordinary(text))) and n == len(ids.split()) and decoded == text.encode()


def test_every_character_beside_others(both):
    codec, library = both
    for cp in range(0, 0x110000, 61):
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            text = f"a{c}1{c}!{c} {c}\n{c}  {c}"
            assert codec.encode(text) == library.encode_ordinary(text), hex(cp)


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000 + "c", " " * 30_000, "=-" * 20_000, "é" * 20_000, "x" + "\n" * 9_999])
def test_long_matches(both, text):
    codec, library = both
    assert codec.encode(text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_long_random_match_backtracks(both):
    codec, library = both
    rng = random.Random(5)
    text = "".join(rng.choice("abcdeinst") for _ in range(100_000))
    assert codec.encode(text) == library.encode_ordinary(text)


def test_small_vocabulary_with_a_token_that_merging_never_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"abcd": 260, b"bcd": 261}
    library = tiktoken.Encoding("own", pat_str="[a-z]+|.", mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.ByteCodec(ranks, "[a-z]+|.")
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        assert codec.encode(text) == library.encode_ordinary(text), text


def test_caches_are_bounded(both, monkeypatch):
    codec, _ = both
    monkeypatch.setattr(byte_bpe, "CACHED_BYTES", 20_000)
    rng = random.Random(6)
    codec.forget()
    for _ in range(500):
        codec.coded(" " + "".join(rng.choice("abcdefgh") for _ in range(9)))
        assert codec.kept.bytes <= 10_000 + 1_000 and len(codec.kept) + len(codec.kept.old) <= 60
    codec.forget()
    assert not codec.kept and not codec.kept.old


def test_odd_documents(spark, both):
    docs = odd_docs(spark)
    got = sorted(map(tuple, queries.byte_bpe.encode_documents(docs.withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "a.b"), RANKS, public_tokenizers.PATTERN).collect()), key=str)
    assert got == sorted([(d.doc_id, *row(both[1], d.text)) for d in docs.collect()], key=str)
    assert byte_bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    broken = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    assert byte_bpe.encode_documents(broken, RANKS, public_tokenizers.PATTERN).first().decoded_sha256 == row(both[1], "a�b")[2]


def test_query_equals_the_library(spark, both):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op13_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    assert all(tuple(r)[1:] == row(both[1], texts[r.doc_id]) for r in got)
