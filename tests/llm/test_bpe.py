import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from memlattice.llm import bpe, queries


@pytest.fixture(scope="module")
def codec():
    return bpe.load(P.path(queries.RANK_FILE), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def encoded(codec, texts):
    flat, ends = codec.encode(pa.array(texts, pa.string()))
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def test_random_texts_equal_the_library(codec, library):
    draw = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "12", "!", "the", "ing", "\r\n", "漢字", "😀", "\x1c", "\u2003", "<|endoftext|>", "\x00"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    for text, ids in zip(texts, encoded(codec, texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids, step=5).tobytes() == text.encode()


def test_plain_words_with_marks_equal_the_library(codec, library):
    draw = random.Random(2)
    words = ["don't", "x's", "a,b", "it'll.", "été,", "«mot»", "3.14", "a--b", "...", "'", "Ünï!", "abc'tion", "e2e", "漢字,", "ǅ.", "ª,", "#", "\u0301x"]
    texts = [draw.choice([" ", "\n"]).join(draw.choice(words) for _ in range(draw.randint(1, 9))) for _ in range(1500)]
    for text, ids in zip(texts, encoded(codec, texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_very_long_pre_token(codec, library):
    text = "ab" * 20_000 + "theing" * 5_000 + "a" * 30_001
    assert encoded(codec, [text])[0].tolist() == library.encode_ordinary(text)


def test_a_lower_rank_made_by_a_merge_goes_first():
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"abc": 1, b"ab": 300, b"bc": 301, b"cab": 2}
    made = bpe.ByteBPE(ranks, P.PATTERN)
    own = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(3)
    for _ in range(500):
        text = "".join(draw.choice("abc") for _ in range(draw.randint(1, 12)))
        assert encoded(made, [text])[0].tolist() == own.encode_ordinary(text)


def test_query_on_the_table(spark, sf_dir, corpus, library):
    for row in queries.op1_byte_bpe(spark, sf_dir).collect():
        expected = library.encode_ordinary(corpus[row.doc_id] or "")
        assert row.n_tokens == len(expected)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((corpus[row.doc_id] or "").encode()).hexdigest()


def test_nulls_repeats_and_empty_tables(docs, empty, spark):
    path = P.path(queries.RANK_FILE)
    frame = docs(None, "", "same text", "x" * 100_000)
    frame = frame.union(frame.where("doc_id = 2")).withColumnRenamed("lang", "token_ids")
    rows = bpe.digests(bpe.encode(frame, path, P.PATTERN)).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 2, 3]
    assert {r.n_tokens for r in rows if r.doc_id < 2} == {0}
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def test_rank_file_is_read_as_written(codec):
    with open(P.path(queries.RANK_FILE), "rb") as lines:
        token, rank = next(iter(lines)).split()
    assert codec.tokens[int(rank)] == base64.b64decode(token)
