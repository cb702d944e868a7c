"""License places against brute force."""

import math
import random
import re

from memlattice.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    have = words(text)
    found = []
    for phrase, label in licenses.BASE:
        asked = phrase.split()
        found += [(k, label) for k in range(len(have)) if have[k : k + len(asked)] == asked]
    return have, found


def check(rows, texts):
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        have, found = base(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (len(have), len(found)), r
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        labels = set(filter(None, r.labels.split(",")))
        assert {x for _, x in found} <= labels and ",".join(sorted(labels)) == r.labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_whole_table(spark, sf_dir, corpus):
    rows = queries.op11_license_index(spark, sf_dir).collect()
    check(rows, corpus)
    for r in rows:
        text = corpus[r.doc_id] or ""
        for line, label in (("CC BY-NC 4.0", "cc-by-nc-4.0"), ("GNU General Public License, version 3", "gpl-3.0"), ("Apache License, Version 2.0", "apache-2.0"), ("MIT License", "mit")):
            assert (f"icensed under the {line}" in text or f"icensed under {line}" in text or f"eleased under the {line}" in text) <= (label in r.labels.split(","))


def test_random_texts(spark, docs, monkeypatch):
    draw = random.Random(5)
    pool = ["gnu", "GNU", "general", "public", "license", "License.", "apache", "cc", "by", "mit", "é", "İ", "x", "0", "cc-by", "mit\nlicense", "K", "gnugeneral", "publicé"]
    texts = [" ".join(draw.choices(pool, k=draw.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "apache license " * 500, "cc by", "CC BY", "\u0080 mit license", "a" * 5000 + " MIT License", "mit" * 3000 + " license"]
    for piece in (licenses.PIECE, 64):
        monkeypatch.setattr(licenses, "PIECE", piece)
        index = licenses.Index()
        index.weigh({}, 1)
        counts, places = index.match([(t or "").encode() for t in texts])
        for t, n, found in zip(texts, counts, places, strict=True):
            have, expected = base(t)
            assert n == len(have)
            assert sorted((p["start"], p["label"]) for p in found if p["base"]) == sorted(expected)
    check(licenses.digests(licenses.find(docs(*texts))).collect(), dict(enumerate(texts)))


def test_notices_need_place_and_key_phrases(docs):
    mit = licenses.NOTICES[7].text
    assert licenses.NOTICES[7].label == "mit"
    named = mit.replace("of this software", "of this fine little software")
    halved = mit.replace("free of charge", "for a charge")
    shuffled = " ".join(random.Random(1).sample(mit.split(), len(mit.split())))
    far = " ".join(w + " word" * 9 for w in mit.split())
    rows = {r.doc_id: r for r in licenses.find(docs("one two " + mit.upper() + " three", named, halved, shuffled, far, "some other text")).collect()}
    label = lambda k: [(p.label, p.start) for p in rows[k].places]
    assert label(0) == [("mit", 2)] and math.isclose(rows[0].places[0].share, 1)
    assert label(1) == [("mit", 0)]
    assert [label(k) for k in (2, 3, 4, 5)] == [[], [], [], []]


def test_weights_count_all_rows(docs):
    index = licenses.Index()
    counts, rows = licenses.document_counts(docs("gnu gnu", "GNU general", None, "x"), index)
    by_word = {index.vocabulary.words[k].decode(): n for k, n in counts.items() if n}
    assert (by_word, rows) == ({"gnu": 2, "general": 1}, 4)


def test_edges(docs, empty, spark):
    frame = docs("mit license", None).union(docs("cc by").selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))
    frame = frame.union(frame).withColumnsRenamed({"lang": "places", "source": "_x.y", "n_chars": "n_words"})
    rows = licenses.digests(licenses.find(frame)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.labels) for r in rows) == sorted(2 * [(False, 0, "mit"), (False, 1, ""), (True, 0, "cc-by")])
    assert licenses.digests(licenses.find(empty)).count() == 0
