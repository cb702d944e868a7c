"""Repeated passages whose lines are frequent elsewhere, against a brute force that asks for every repeated pair of lines."""

import collections
import random
import re

from test_dedup import spark_hash

from memlattice.llm import line_dedup, queries


def without_repeated_passages(texts):
    """The lines of each text that stay, with runs of all repeated gaps as well as of those that lines share in most of their places."""
    split = [[(p, line) for p, line in enumerate(t.split("\n")) if line] for t in texts]
    single = collections.Counter(line for lines in split for _, line in lines)
    both = collections.Counter((a, b) for lines in split for (_, a), (_, b) in zip(lines, lines[1:], strict=False))
    repeated = {gap for gap, n in both.items() if n > 1}
    most = {(a, b) for a, b in repeated if 2 * both[a, b] > single[a] and 2 * both[a, b] > single[b]}
    cut = lambda a, b: spark_hash(spark_hash(a), spark_hash(b)) % line_dedup.ROLLING == 0
    chunks = set()
    for d, lines in enumerate(split):
        gaps = [(a, b) for (_, a), (_, b) in zip(lines, lines[1:], strict=False)]
        kinds = [lambda g, held=held: g in held for held in (repeated, most)]
        kinds += [lambda g, held=held: g in held and not cut(*g) for held in (repeated, most)]
        kinds += [lambda g, held=held, n=n: g in held and both[g] == n for held in (repeated, most) for n in {both[g] for g in gaps}]
        for joined in kinds:
            start = 0
            for k in range(1, len(lines) + 1):
                if k == len(lines) or not joined(gaps[k - 1]):
                    if k - start > 1:
                        chunks.add((tuple(line for _, line in lines[start:k]), (d, start)))
                    start = k
        chunks |= {((line,), (d, k)) for k, (_, line) in enumerate(lines) if len(re.findall(r"[^ \t-\r]+", line)) >= 50}
    first, gone = {}, [set() for _ in texts]
    for text, place in chunks:
        first[text] = min(first.get(text, place), place)
    for text, (d, k) in chunks:
        if first[text] != (d, k):
            gone[d] |= set(range(split[d][k][0], split[d][k + len(text) - 1][0] + 1))
    return ["\n".join(line for p, line in enumerate(t.split("\n")) if p not in gone[d]) for d, t in enumerate(texts)]


def test_a_passage_goes_though_its_lines_are_frequent_elsewhere(docs):
    passage = ["first line of it", "And more.", "last line of it"]
    texts = ["\n".join([f"head {i}", *passage, f"tail {i}"]) for i in range(3)]
    texts += ["Welcome.\nonly here", *(f"own {i}\nAnd more.\nown too {i}\nWelcome." for i in range(8))]
    texts += ["Welcome.\nbody of a page\nmore of its body\nAnd more."] * 2
    rows = {r.doc_id: r.text for r in line_dedup.dedup(docs(*texts)).collect()}
    expected = dict(enumerate(texts)) | {1: "head 1\ntail 1", 2: "head 2\ntail 2", len(texts) - 1: ""}
    assert rows == expected


def test_line_query_against_all_repeated_pairs(spark, sf_dir, corpus):
    rows = {r.doc_id: r.text for r in queries.op3_line_chunks(spark, sf_dir).collect()}
    ids = sorted(i for i in corpus if corpus[i] is not None)
    assert [rows[i] for i in ids] == without_repeated_passages([corpus[i] for i in ids])


def test_passages_between_frequent_lines_against_brute_force(docs, monkeypatch):
    draw = random.Random(3)
    monkeypatch.setattr(line_dedup, "ROLLING", 3)
    passages = [[draw.choice(["And more.", "Welcome.", f"{p} {k}"]) for k in range(draw.randint(2, 7))] for p in "abcdef"]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(draw.randint(0, 4)):
            lines += [*draw.choice(passages)[: draw.randint(1, 9)], *([f"own {i}"] if draw.random() < 0.5 else [])]
        texts.append("\n".join(lines))
    rows = {r.doc_id: r.text for r in line_dedup.dedup(docs(*texts)).collect()}
    assert [rows[i] for i in range(60)] == without_repeated_passages(texts)
