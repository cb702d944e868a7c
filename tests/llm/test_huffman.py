import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from memlattice.llm import huffman, queries
from memlattice.llm.common import scratch
from memlattice.llm.word_ids import grouped


@pytest.mark.parametrize("n,top,limit", [(1, 1, 20), (5, 3, 20), (3000, 700, 10), (60_000, 20_000, 16)])
def test_round_trip(n, top, limit):
    draw = np.random.default_rng(n)
    ids = np.minimum(draw.zipf(1.2, n), top).astype(np.int64) - 1
    lengths = huffman.code_lengths(np.bincount(ids), limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    code = huffman.Code(lengths, limit)
    bits, marks = code.encode(ids)
    assert np.array_equal(code.decode(bits, marks, n), ids)


def test_lengths_are_optimal_without_a_binding_limit():
    import heapq

    counts = np.array([40, 30, 10, 9, 5, 3, 2, 1])
    heap, total = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    assert int((counts * huffman.code_lengths(counts, 20)).sum()) == total


def test_unused_symbols_and_too_many():
    assert huffman.code_lengths(np.array([0, 0])).tolist() == [0, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, dtype=np.int64), 3)


def test_query_equals_the_library(spark, sf_dir, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(queries.TOKENIZER))
    rows = {r.doc_id: r for r in queries.op9_huffman(spark, sf_dir).collect()}
    start = 0
    for doc_id in sorted(corpus):
        ids = [*library.encode(corpus[doc_id] or "", add_special_tokens=False).ids, 0]
        row = rows[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_any_text_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path(queries.TOKENIZER))
    draw = random.Random(4)
    parts = ["a", "don't", " ", " ", "  ", "\n", "\t", "'s", "é", "12", "!", ",", "theing", "\r\n", "漢字", "😀", "\x1c", "\u2003", "<|endoftext|>", "<|endoftext", "\x01", "«mot»", "ª"]
    texts = ["a <|endoftext|> b", None, "", *("".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(3000))]
    flat, ends = huffman.library(P.path(queries.TOKENIZER))(pa.array(texts, pa.string()))
    assert flat[: ends[1]].tolist() == [64, 220, 50256, 275]
    for k, text in enumerate(texts):
        assert flat[ends[k] : ends[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_groups_keep_rows_in_order():
    rows = [None, "ab", "", "c" * 50, "d", "e" * 9, None]
    batches = pa.table({"k": range(7), "t": pa.array(rows, pa.string())}).to_batches(max_chunksize=3)
    made = list(grouped(iter(batches), 1, 10))
    assert pa.Table.from_batches(made)["t"].to_pylist() == rows
    assert all(sum(len(t or "") for t in b["t"].to_pylist()) <= 10 or b.num_rows == 1 for b in made)


def test_edges(spark, docs, empty):
    frame = docs(None, "", "one two\u2003three  four", "y" * 200_000)
    frame = frame.union(frame.where("doc_id = 2")).withColumnRenamed("lang", "start")
    folder = scratch(spark, "t")
    huffman.write(frame, folder, P.path(queries.TOKENIZER), block_ids=4)
    rows = huffman.digests(huffman.read(spark, folder)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [0, 1, 2, 2, 3] and [r.n_tokens for r in rows[:2]] == [1, 1]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    folder = scratch(spark, "t")
    huffman.write(empty, folder, P.path(queries.TOKENIZER))
    assert huffman.read(spark, folder).count() == 0
