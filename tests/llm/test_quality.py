import collections
import random
import re

from memlattice.llm import quality, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_query_against_brute_force(spark, sf_dir, corpus):
    rows = queries.op10_rule_ledger(spark, sf_dir).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        found = brute(corpus[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == found
        failed = found[0] < 10 or 100 * found[4] > 20 * found[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_edges(docs, empty):
    texts = [None, "", " \t\n\v\f\r ", "a b c d e a b c d e", "a a a a a a", "\n\nx\nx\n \n \n", "😀 é#*$%&|<>", "w " * 20_000, "q" * 100_000, "a b c d", "a b c d e f g a b c d e f"]
    frame = docs(*texts).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "failures")
    rows = {r.doc_id: r for r in quality.digests(quality.ledger(frame)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text
    assert quality.ledger(empty).count() == 0
    assert quality.accept(frame).columns == frame.columns


def test_very_long_texts(docs):
    draw = random.Random(6)
    texts = ["again and again we say it " * 20_000, " ".join(f"w{draw.randint(0, 9999)}" for _ in range(80_000)), "\n".join(f"line {draw.randint(0, 9)} of it" for _ in range(20_000))]
    for r in quality.digests(quality.ledger(docs(*texts))).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_policies_and_ablation(docs):
    clean = " ".join(f"word{i}" for i in range(30))
    book = quality.ledger(docs(clean, "too short", clean.replace(" ", "%% "), ("again and again we say it " * 10).strip())).cache()
    kept = {r.doc_id for r in book.where(~quality.failed(quality.PRODUCTION)).collect()}
    assert kept == {0}
    found = {r.rule: (r.rejected, r.alone) for r in quality.ablation(book, quality.PRODUCTION).collect()}
    assert found["few_words"] == (1, 1) and found["symbols"] == (1, 1) and found["repeated_windows"] == (1, 1)
    assert {r.doc_id for r in book.where(~quality.failed(quality.Policy(3, ("few_words",)))).collect()} == {0, 2, 3}


def test_clean_labels_stay_and_junk_goes(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op10_rule_ledger(spark, sf_dir).join(labels, "doc_id").collect()
    assert not any(r.kept for r in rows if r.quality == 0)
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)
