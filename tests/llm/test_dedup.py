"""SimHash classes, components and line chunks against brute force."""

import collections
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from memlattice.llm import line_dedup, near_copies, quality, queries, shingles, simhash
from memlattice.llm.components import connected


def fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    best = {}
    for i, doc in enumerate(ids):
        best[find(i)] = min(best.get(find(i), doc), doc)
    return [best[find(i)] for i in range(len(ids))]


def test_query_against_all_pairs(spark, sf_dir, corpus):
    rows = {r.doc_id: r for r in queries.op4_simhash(spark, sf_dir).collect()}
    ids = sorted(corpus)
    prints = [fingerprint(corpus[i]) for i in ids]
    assert [int(rows[i].fingerprint, 16) for i in ids] == prints
    assert [rows[i].component_id for i in ids] == classes(ids, prints)


@pytest.mark.parametrize("tile", [8192, 16])
def test_links_of_dense_groups(spark, tile):
    draw = np.random.default_rng(3)
    prints = set()
    for base in draw.integers(0, 2**63, 25).tolist():
        for _ in range(draw.integers(1, 60)):
            near = base
            for bit in draw.integers(0, 64, draw.integers(0, 5)).tolist():
                near ^= 1 << bit
            prints.add(near)
    values = np.array(sorted(prints), dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.node: r.root for r in connected(simhash.links(frame, tile)).collect()}
    expected = classes(list(range(len(values))), np.array(values, dtype=np.int64).view(np.uint64).tolist())
    assert len({(a, roots.get(v, v)) for a, v in zip(expected, values, strict=True)}) == len(set(expected)) == len({roots.get(v, v) for v in values})


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    roots = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_simhash_edges(docs, empty, spark):
    frame = docs(None, "", "one two", "ONE  two", "a b c d e f", "a b c d e f", "z" * 50_000)
    frame = frame.union(frame.where("doc_id = 4")).withColumnRenamed("lang", "_fingerprint")
    rows = collections.defaultdict(set)
    for r in simhash.digests(simhash.classify(frame)).collect():
        rows[r.doc_id].add((r.fingerprint, r.component_id))
    assert rows[0] == rows[1] == {("0" * 16, 0)}
    assert rows[2] == rows[3] and {c for _, c in rows[5]} == {4}
    assert simhash.classify(empty).count() == 0


CLASHES = ["_text", "_id", "_hash", "_l", "_node", "_ranges", "ranges", "root", "node", "_stay", "_t", "_w", "_h", "_items", "score", "with.dot", "_c`x"]


def clashing(frame):
    """``frame`` with columns named like work columns, each holding its own name."""
    return frame.select("*", *(F.lit(c).alias(c) for c in CLASHES))


def kept_own(frame, rows):
    names = [c for c in frame.columns if c in CLASHES]
    return names == CLASHES and all([row[frame.columns.index(c)] for c in CLASHES] == CLASHES for row in rows)


def test_stages_keep_columns_of_any_name(docs, spark, sf_dir):
    import corpus_pipeline

    texts = [" ".join(f"w{i}x{k}" for k in range(60)) + "\n" + "\n".join(PASSAGE) for i in range(5)]
    frame = clashing(docs(*texts, texts[0]))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        if name == "line dedup":
            result = line_dedup.dedup(frame)
        else:
            result = stage(spark, frame, sf_dir)
            assert result.columns == frame.columns
        assert kept_own(result, result.collect()), name
    book = quality.ledger(frame)
    assert kept_own(book, book.collect())
    assert kept_own(quality.accept(frame), quality.accept(frame).collect())


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_classes(texts):
    """The place of the first text of each text's class, by comparing all pairs."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if (not a and not sets[j]) or shared >= 0.8 * (len(a) + len(sets[j]) - shared) - 1e-9:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(texts))]


def varied(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        words[draw.integers(0, len(words))] = f"new{draw.integers(0, 10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("tile", [4096, 24])
def test_near_copies_against_all_pairs(docs, tile):
    draw = np.random.default_rng(5)
    base = [[f"v{b}w{draw.integers(0, 400)}" for _ in range(draw.integers(60, 300))] for b in range(12)]
    texts = [" ".join(words) for words in base]
    for words in base:
        texts += [varied(draw, words, int(len(words) * share)) for share in (0.005, 0.01, 0.012, 0.015, 0.05, 0.2)]
    texts += [varied(draw, base[0], 1) for _ in range(90)] + ["", "  ", "one two", "ONE\ttwo", "one two three", texts[3], texts[3]]
    rows = {r.doc_id: r.root for r in near_copies.classes(docs(*texts), tile).collect()}
    expected = near_classes(texts)
    pairs = collections.defaultdict(set)
    for i, place in enumerate(expected):
        pairs[place].add(rows[i])
    # Chance may split a class, never join two.
    assert len(set(rows.values())) == sum(map(len, pairs.values()))
    assert sum(len(found) - 1 for found in pairs.values()) <= 1


def test_near_copies_of_large_tables_of_keys():
    for texts in (10, 10**6, 10**9):
        segments = near_copies.layout(texts)
        assert texts >> len(segments[0]) <= near_copies.BY_CHANCE and len({tuple(s) for s in segments}) == len(segments)
        assert all(len(set(s)) == len(segments[0]) for s in segments) and near_copies.expected_recall(0.8, texts) > 0.95


def test_a_long_text_is_hashed_in_pieces(monkeypatch):
    draw = np.random.default_rng(2)
    texts = [b" ".join(b"w%d" % w for w in draw.integers(0, 99, n)) + b" \n" * (n % 3) for n in (0, 1, 3, 4, 5, 6, 50, 3000, 4, 700)] + [b"x" * 5000, b"  "]
    whole = [x.tolist() for x in shingles.shingle_hashes(texts)]
    for piece in (40, 64, 1000):
        monkeypatch.setattr(shingles, "PIECE", piece)
        cut = [x.tolist() for x in shingles.shingle_hashes(texts)]
        assert sorted(zip(*cut, strict=True)) == sorted(zip(*whole, strict=True))


def test_near_copy_edges(docs, empty):
    frame = docs(None, "", "one two", "ONE  two", "a b c d e f", "a b c d e f", "z" * 50_000, "y " * 400_000)
    frame = frame.union(frame.where("doc_id = 4")).withColumnRenamed("lang", "_node")
    kept = near_copies.dedup(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6, 7]
    assert near_copies.dedup(empty).count() == 0


def test_unrelated_texts_with_null_or_equal_ids_stay(docs):
    frame = docs(*(" ".join(f"w{i}x{k}" for k in range(40)) for i in range(6)))
    frame = frame.selectExpr("case when doc_id < 3 then null else 7L end as doc_id", "text", "lang", "source", "n_chars")
    assert sorted(r.text for r in near_copies.dedup(frame.union(frame)).collect()) == sorted(r.text for r in frame.collect())


PASSAGE = ["P one two three four five six seven eight nine ten eleven twelve thirteen", "Q one two three four five six seven eight nine ten eleven twelve thirteen"]


def test_a_passage_leaves_all_but_its_first_document(docs):
    texts = ["\n".join([f"head {i} of its own", *PASSAGE, f"tail {i} of its own"]) for i in range(4)] + ["clean text\nof two lines", None, ""]
    rows = {r.doc_id: r for r in line_dedup.dedup(docs(*texts)).collect()}
    assert rows[0].text == texts[0] and rows[0].n_removed == 0
    for i in (1, 2, 3):
        assert rows[i].text == f"head {i} of its own\ntail {i} of its own" and rows[i].n_removed == 2 and rows[i].n_chars == len(rows[i].text)
    assert rows[4].text == texts[4] and rows[5].text is None and rows[6].text == ""


def test_short_lines_stay_and_long_lines_go(docs):
    long = " ".join(f"w{i}" for i in range(60))
    rows = {r.doc_id: r.text for r in line_dedup.dedup(docs(f"All rights reserved.\n{long}\nfirst", f"All rights reserved.\nother\n{long}\nsecond", "All rights reserved.")).collect()}
    assert rows == {0: f"All rights reserved.\n{long}\nfirst", 1: "All rights reserved.\nother\nsecond", 2: "All rights reserved."}


def test_line_query_keeps_every_row_and_every_unique_line(spark, sf_dir, corpus):
    rows = {r.doc_id: r for r in queries.op3_line_chunks(spark, sf_dir).collect()}
    assert rows.keys() == corpus.keys()
    times = collections.Counter(line for t in corpus.values() if t is not None for line in t.split("\n"))
    survivors = collections.Counter(line for r in rows.values() if r.text is not None for line in r.text.split("\n"))
    assert all(survivors[line] >= 1 for line in times if line)
    for doc_id, r in rows.items():
        before, after = (corpus[doc_id] or "").split("\n"), (r.text or "").split("\n")
        left = iter(before)
        assert r.n_removed == len(before) or all(line in left for line in after)
        assert r.n_removed or r.text == corpus[doc_id]


def test_line_edges(docs, empty):
    frame = docs("a b c d e\nf g h i j", "a b c d e\nf g h i j", "\n" * 3000, "x" * 50_000)
    frame = frame.union(frame.where("doc_id = 1")).withColumnRenamed("lang", "n_lines")
    rows = line_dedup.dedup(frame).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(0, 0), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert line_dedup.dedup(empty).count() == 0


def spark_hash(*values):
    """XXH64 over values one after the other, as Spark chains it."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), seed)
    return seed


def without_repeats(texts):
    """The lines of each text (by place in the list) that stay, by listing all chunks and comparing their lines."""
    split = [[(p, line) for p, line in enumerate(t.split("\n")) if line] for t in texts]
    single = collections.Counter(line for lines in split for _, line in lines)
    both = collections.Counter((a, b) for lines in split for (_, a), (_, b) in zip(lines, lines[1:], strict=False))
    together = {(a, b) for (a, b), n in both.items() if n > 1 and 2 * n > single[a] and 2 * n > single[b]}
    cut = lambda a, b: spark_hash(spark_hash(a), spark_hash(b)) % line_dedup.ROLLING == 0

    def pieces(lines, joined):
        start = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or not joined(k):
                if k - start > 1:
                    yield start, k
                start = k

    chunks = []
    for d, lines in enumerate(split):
        text = [line for _, line in lines]
        gap = lambda k: (text[k - 1], text[k])  # noqa: B023, E731
        runs = set(pieces(lines, lambda k: gap(k) in together))  # noqa: B023
        parts = set(pieces(lines, lambda k: gap(k) in together and not cut(*gap(k))))  # noqa: B023
        for n in {both[gap(k)] for k in range(1, len(lines))}:
            parts |= set(pieces(lines, lambda k: gap(k) in together and both[gap(k)] == n))  # noqa: B023
        parts |= {(k, k + 1) for k, line in enumerate(text) if len(re.findall(r"[^ \t-\r]+", line)) >= 50}
        chunks += [(tuple(text[a:b]), (d, a), b, (a, b) in runs) for a, b in runs | parts]
    first = {}
    for text, place, _, _ in chunks:
        first[text] = min(first.get(text, place), place)
    gone = [set() for _ in texts]
    for text, (d, a), b, _ in chunks:
        if first[text] != (d, a):
            gone[d] |= set(range(split[d][a][0], split[d][b - 1][0] + 1))
    return ["\n".join(line for p, line in enumerate(t.split("\n")) if p not in gone[d]) for d, t in enumerate(texts)]


def test_line_query_against_all_chunks(spark, sf_dir, corpus):
    rows = {r.doc_id: r.text for r in queries.op3_line_chunks(spark, sf_dir).collect()}
    ids = sorted(i for i in corpus if corpus[i] is not None)
    assert [rows[i] for i in ids] == without_repeats([corpus[i] for i in ids])


def test_nothing_is_put_together_from_several_documents(docs, monkeypatch):
    a, b, c, d = ("A line", "B line", "C line", "D line")
    texts = [f"{a}\n{b}\nx1", f"x2\n{b}\n{c}", f"{c}\n{d}\nx3", f"{a}\n{b}\n{c}\n{d}"]
    monkeypatch.setattr(line_dedup, "ROLLING", 1 << 40)  # no cut here by chance
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs(*texts)).collect()} == dict(enumerate(texts))


def test_whatever_goes_stands_whole_in_one_document_before(docs, monkeypatch):
    import random

    draw = random.Random(7)
    for rolling in (2, 8):
        monkeypatch.setattr(line_dedup, "ROLLING", rolling)
        passages = [[f"{p} {k}" for k in range(draw.randint(1, 7))] for p in "abcdef"]
        texts = []
        for i in range(60):
            lines = []
            for _ in range(draw.randint(0, 4)):
                lines += [*draw.choice(passages)[: draw.randint(1, 9)], *([""] * draw.randint(0, 1)), *([f"own {i}"] if draw.random() < 0.5 else [])]
            texts.append("\n".join(lines))
        rows = {r.doc_id: r.text for r in line_dedup.dedup(docs(*texts)).collect()}
        assert [rows[i] for i in range(60)] == without_repeats(texts)
        assert sum(len(texts[i]) > len(rows[i]) for i in rows) > 10


def test_a_passage_goes_whatever_its_lines_do_elsewhere(docs):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    texts = [f"one\n{a}\n{b}\n{c}\n{d}\nlast", f"alone\n{b}\nby itself", f"two\n{a}\n{b}\n\n{c}\n{d}", f"three\n{a}\n{b}\ncut short", f"short line\n{a}\n{b}\n{c}\n{d}", "short line\nanother"]
    rows = {r.doc_id: r.text for r in line_dedup.dedup(docs(*texts)).collect()}
    assert rows == {0: texts[0], 1: texts[1], 2: "two", 3: "three\ncut short", 4: "short line", 5: texts[5]}


def test_a_passage_goes_behind_any_line(docs):
    texts = ["\n".join([f"before {i} it", *PASSAGE, f"after {i} it"]) for i in range(200)]
    rows = {r.doc_id: r.text for r in line_dedup.dedup(docs(*texts)).collect()}
    assert rows == {0: texts[0]} | {i: f"before {i} it\nafter {i} it" for i in range(1, 200)}


def test_pipeline_stages_against_brute_force(spark, sf_dir, corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    ids = sorted(i for i in corpus if corpus[i] is not None)
    lines = corpus_pipeline.materialized(corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir), "t")
    expected = without_repeats([corpus[i] for i in ids])
    assert dict(lines.select("doc_id", "text").collect()) == dict(zip(ids, expected, strict=True))
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, lines, sf_dir).collect()}
    assert kept == {ids[k] for k in near_classes(expected)}


@pytest.mark.parametrize("sides", [False, True])
def test_trees_of_many_shapes_against_all_pairs(sides):
    draw = np.random.default_rng(9)
    for n, groups, noise in ((1, 1, 1), (40, 1, 3), (300, 60, 9), (200, 3, 40), (250, 200, 2)):
        bases = [draw.integers(0, 2**63, 60).astype(np.uint64) for _ in range(groups)]
        sets = []
        for _ in range(n):
            own = bases[draw.integers(0, groups)].copy()
            changed = draw.choice(60, draw.integers(0, noise + 1), replace=False)
            own[changed] = draw.integers(0, 2**63, len(changed)).astype(np.uint64)
            sets.append(np.unique(own))
        side = draw.integers(0, 2, n) if sides else None
        for dense in (2048, 5):
            held = near_copies.Sets(sets, dense)
            left, right = near_copies.tree(n, held.similar, side, step=16, walks=2)
            parent, made = list(range(n)), list(range(n))
            for i in range(n):
                for j in range(i):
                    shared = len(np.intersect1d(sets[i], sets[j]))
                    if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) and (side is None or side[i] != side[j]):
                        parent = [min(parent[i], parent[j]) if p in (parent[i], parent[j]) else p for p in parent]
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                made = [min(made[i], made[j]) if p in (made[i], made[j]) else p for p in made]
            assert made == parent and len(left) == n - len(set(made))
