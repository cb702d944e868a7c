"""License scans by a positional index of rare template words.

Templates are license notices and short phrases as sequences of words.  The index
lists, for each word, the templates and places it stands at.  Words are weighed by
their inverse document frequency over all documents.  A file looks up its
highest-weighted words of each template; a lookup at word ``p`` of the file and word
``t`` of the template votes for an alignment that starts at ``p - t``, and votes are
intersected by that start: exactly for phrases, within a few words for notices, which
differ in names and years.  A notice's label also needs all its key phrases, found as
phrases, inside the aligned span.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.llm.common import arrow_rows, text_or_empty
from memlattice.llm.shingles import mix

#: Fixed values of the query's contract: phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Notice:
    """A template: its label, its words, and phrases without which it is another license."""

    label: str
    text: str
    phrases: tuple[str, ...]


NOTICES = (
    Notice("gpl-2.0", "licensed under the terms of the gnu general public license version 2", ("gnu general public license", "version 2")),
    Notice("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Notice("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    Notice("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Notice("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("licenses license 2 0",)),
    Notice("mit", "released under the mit license", ("mit license",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Notice("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Notice("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Notice("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Notice("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Notice("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
)

#: Words of a template that a file looks up, the weightiest it has; phrases look up all of theirs.
LOOKUPS = 8
#: Words by which an alignment may shift, and the share of a notice's weight that it must hold.
SLACK, SHARE = 4, 0.6
#: The templates travel with each task; the index is refused beyond this many words.
MOST_WORDS = 1_000_000
#: Bytes looked at in one step.
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_PLACES = "array<struct<label:string,start:long,n_words:int,share:double,base:boolean>>"


def split(text: bytes) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered, as UTF-8."""
    data = np.frombuffer(text, dtype=np.uint8)
    return np.where(_WORD[data], _LOWER[data], np.uint8(32)).tobytes().split()


class Vocabulary:
    """The words of all templates; ``scan`` finds them in texts."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.low, self.high = (np.array([int.from_bytes(w[k : k + 8], "little") for w in words], dtype=np.uint64) for k in (0, 8))
        keys = self._key(self.low, self.high, self.sizes)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two template words have one key")
        self.first, self.size = np.zeros(256, dtype=bool), np.zeros(max(self.sizes, default=0) + 1, dtype=bool)
        self.first[[w[0] for w in words]] = True
        self.size[self.sizes] = True

    @staticmethod
    def _key(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(low ^ mix(high + size.astype(np.uint64)))

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and text, place and number of every word of the vocabulary, by text and place."""
        data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(16), dtype=np.uint8)
        end_of_all = len(data) - 16
        borders = np.cumsum([len(t) + 1 for t in texts])
        counts = np.zeros(len(texts), dtype=np.int64)
        found, start, before = [], 0, 0
        while start < end_of_all:
            end = min(start + PIECE, end_of_all)
            while end < end_of_all and _WORD[data[end - 1]]:  # a word is never cut
                rest = np.flatnonzero(~_WORD[data[end : end + 4096]])
                end = end + int(rest[0]) + 1 if len(rest) else min(end + 4096, end_of_all)
            inside = _WORD[data[start:end]]
            edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8))) + start
            starts, sizes = edges[::2], edges[1::2] - edges[::2]
            counts += np.bincount(np.searchsorted(borders, starts, side="right"), minlength=len(texts))[: len(texts)]
            some = np.flatnonzero((sizes < len(self.size)) & self.first[_LOWER[data[starts]]])
            some = some[self.size[sizes[some]]]
            at, size = starts[some], sizes[some]
            packed = [np.zeros(len(some), dtype=np.uint64), np.zeros(len(some), dtype=np.uint64)]
            for k in range(min(16, len(self.size) - 1)):
                byte = np.where(size > k, _LOWER[data[at + np.minimum(k, size)]], 0).astype(np.uint64)
                packed[k // 8] |= byte << np.uint64(8 * (k % 8))
            place = np.minimum(np.searchsorted(self.keys, self._key(*packed, size)), len(self.keys) - 1)
            word = self.order[place]
            same = (self.low[word] == packed[0]) & (self.high[word] == packed[1]) & (self.sizes[word] == size)
            for k in np.flatnonzero(same & (size > 16)).tolist():
                same[k] = _LOWER[data[at[k] : at[k] + size[k]]].tobytes() == self.words[word[k]]
            found.append((np.searchsorted(borders, at[same], side="right"), some[same] + before, word[same]))
            before += len(starts)
            start = end
        text, number, word = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
        return counts, text, number - (np.cumsum(counts) - counts)[text], word


class Index:
    """Postings of template words: exact phrases first, then notices."""

    def __init__(self, base=BASE, notices=NOTICES):
        self.base, self.notices = base, notices
        phrases = list(dict.fromkeys([*(p for p, _ in base), *(p for n in notices for p in n.phrases)]))
        self.phrase_of = {p: k for k, p in enumerate(phrases)}
        self.templates = [split(t.encode()) for t in [*phrases, *(n.text for n in notices)]]
        self.n_phrases = len(phrases)
        if not all(self.templates) or sum(map(len, self.templates)) > MOST_WORDS:
            raise ValueError(f"templates need words, and at most {MOST_WORDS} in all")
        words = sorted({w for t in self.templates for w in t})
        number = {w: k for k, w in enumerate(words)}
        self.vocabulary = Vocabulary(words)
        rows = sorted((number[w], k, p) for k, t in enumerate(self.templates) for p, w in enumerate(t))
        self.post_word, self.post_template, self.post_place = np.array(rows, dtype=np.int64).reshape(-1, 3).T
        self.post_from = np.searchsorted(self.post_word, np.arange(len(words) + 1))
        self.pairs = np.unique(np.array([(w, k) for w, k, _ in rows], dtype=np.int64).reshape(-1, 2), axis=0)
        self.pair_from = np.searchsorted(self.pairs[:, 0], np.arange(len(words) + 1))
        self.sizes = np.array([len(t) for t in self.templates])
        self.distinct = np.bincount(self.pairs[:, 1], minlength=len(self.templates))

    def weigh(self, counts: dict[int, int], rows: int) -> None:
        """Weights of words from the documents that hold them."""
        self.weight = np.array([math.log(1 + rows / (1 + counts.get(k, 0))) for k in range(len(self.vocabulary.words))])
        self.total = np.bincount(self.pairs[:, 1], weights=self.weight[self.pairs[:, 0]], minlength=len(self.templates))

    def lookups(self, text: np.ndarray, word: np.ndarray) -> np.ndarray:
        """(text, template, word) for the weightiest words of each template that a text can still match."""
        both = np.unique(np.stack([text, word], axis=1), axis=0)
        n = self.pair_from[both[:, 1] + 1] - self.pair_from[both[:, 1]]
        row = np.repeat(np.arange(len(both)), n)
        template = self.pairs[_ranges(self.pair_from[both[:, 1]], n), 1]
        rows = np.stack([both[row, 0], template, both[row, 1]], axis=1)
        group, inverse, has = np.unique(rows[:, 0] * len(self.templates) + rows[:, 1], return_inverse=True, return_counts=True)
        template = group % len(self.templates)
        held = np.bincount(inverse, weights=self.weight[rows[:, 2]], minlength=len(group))
        open_ = np.where(template < self.n_phrases, has == self.distinct[template], held >= SHARE * self.total[template] - 1e-9)
        rows = rows[open_[inverse]]
        rows = rows[np.lexsort((rows[:, 2], -self.weight[rows[:, 2]], rows[:, 1], rows[:, 0]))]
        key = rows[:, 0] * len(self.templates) + rows[:, 1]
        rank = np.arange(len(rows)) - np.searchsorted(key, key)
        return rows[(rank < LOOKUPS) | (rows[:, 1] < self.n_phrases)]

    def votes(self, asked: np.ndarray, text: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """(text, template, start, word, place in template) of every lookup, sorted."""
        words = len(self.vocabulary.words)
        hit_key, asked_key = text * words + word, asked[:, 0] * words + asked[:, 2]
        order = np.argsort(hit_key, kind="stable")
        first, last = (np.searchsorted(hit_key[order], asked_key, side=s) for s in ("left", "right"))
        row = np.repeat(np.arange(len(asked)), last - first)
        at = place[order][_ranges(first, last - first)]
        template, of = asked[row, 1], asked[row, 2]
        n = self.post_from[of + 1] - self.post_from[of]
        line = np.repeat(np.arange(len(row)), n)
        posting = _ranges(self.post_from[of], n)
        same = self.post_template[posting] == template[line]
        line, posting = line[same], posting[same]
        found = np.stack([asked[row[line], 0], template[line], at[line] - self.post_place[posting], of[line], self.post_place[posting]], axis=1)
        return found[np.lexsort(found.T[::-1])]

    def match(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[dict]]]:
        """Words and places of each text."""
        counts, text, place, word = self.vocabulary.scan(texts)
        found = self.votes(self.lookups(text, word), text, place, word)
        exact, loose = found[found[:, 1] < self.n_phrases], found[found[:, 1] >= self.n_phrases]
        cuts = np.flatnonzero(np.any(np.diff(exact[:, :3], axis=0, prepend=-1 - exact[:1, :3]) != 0, axis=1))
        full = np.diff(np.r_[cuts, len(exact)]) == self.sizes[exact[cuts, 1]]
        phrases = exact[cuts[full], :3]
        out: list[list[dict]] = [[] for _ in texts]
        for phrase, label in self.base:
            for row in phrases[phrases[:, 1] == self.phrase_of[phrase]]:
                out[row[0]].append({"label": label, "start": int(row[2]), "n_words": int(self.sizes[row[1]]), "share": 1.0, "base": True})
        groups = np.flatnonzero(np.any(np.diff(loose[:, :2], axis=0, prepend=-1 - loose[:1, :2]) != 0, axis=1))
        for a, b in zip(groups.tolist(), np.append(groups, len(loose)).tolist()[1:], strict=True):
            number, template = int(loose[a, 0]), int(loose[a, 1])
            if best := self._aligned(loose[a:b], text, place, word, phrases[phrases[:, 0] == number]):
                notice = self.notices[template - self.n_phrases]
                out[number].append({"label": notice.label, "start": best[1], "n_words": int(self.sizes[template]), "share": best[0], "base": False})
        return counts, [sorted(o, key=lambda p: (p["start"], p["label"], not p["base"], p["n_words"])) for o in out]

    def _aligned(self, votes: np.ndarray, text: np.ndarray, place: np.ndarray, word: np.ndarray, phrases: np.ndarray) -> tuple[float, int] | None:
        """The share and start of a notice's best alignment that holds its key phrases."""
        number, template = int(votes[0, 0]), int(votes[0, 1])
        # The words found vote for starts; all other template words of the text then count as well.
        starts = np.unique(votes[:, 2])
        own = slice(*np.searchsorted(text, [number, number + 1]))
        mine = self.pairs[self.pairs[:, 1] == template, 0]
        words, places = word[own], place[own]
        inside = np.isin(words, mine)
        asked = np.stack([np.full(len(mine), number), np.full(len(mine), template), mine], axis=1)
        every = self.votes(asked, np.full(inside.sum(), number), places[inside], words[inside])
        every = every[np.argsort(every[:, 2], kind="stable")]
        needed, spans = [], []
        for p in self.notices[template - self.n_phrases].phrases:
            needed.append(np.sort(phrases[phrases[:, 1] == self.phrase_of[p], 2]))
            spans.append(len(self.templates[self.phrase_of[p]]))
        best, held, weight, right, left = None, Counter(), 0.0, 0, 0
        for start in starts.tolist():
            while right < len(every) and every[right, 2] <= start + SLACK:
                w = int(every[right, 3])
                weight += 0.0 if held[w] else self.weight[w]
                held[w] += 1
                right += 1
            while left < right and every[left, 2] < start:
                w = int(every[left, 3])
                held[w] -= 1
                weight -= 0.0 if held[w] else self.weight[w]
                left += 1
            share = min(1.0, weight / self.total[template])
            if share >= SHARE - 1e-9 and (best is None or share > best[0] + 1e-9):
                low, high = max(start, 0), start + int(self.sizes[template]) + SLACK
                if all(np.searchsorted(n, low) < np.searchsorted(n, high - s, side="right") for n, s in zip(needed, spans, strict=True)):
                    best = (round(share, 9), max(start, 0))
        return best


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers first, first + 1, ... of each range of n, one range after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def document_counts(docs: DataFrame, index: Index) -> tuple[dict[int, int], int]:
    """In how many rows each word of the templates stands, and the number of rows; one row a template word reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(index.vocabulary.words) + 1, dtype=np.int64)
        for batch in batches:
            _, text, _, word = index.vocabulary.scan(batch.column(0).to_pylist())
            both = np.unique(text * (len(counts) - 1) + word)
            counts[:-1] += np.bincount(both % (len(counts) - 1), minlength=len(counts) - 1)
            counts[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["word", "n"])

    found = docs.select(text_or_empty().cast("binary").alias("text")).mapInArrow(run, "word long, n long")
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts, counts.pop(len(index.vocabulary.words), 0)


def find(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """``doc_id``, ``n_words`` and ``places`` of every row: label, first word, words of the template, share of its weight, whether of ``base``.

    Two passes over the texts and no shuffle of them: documents that hold each template
    word are counted over all rows, then every whole text is matched.  A null text
    counts as empty and has no places; repeated rows give equal rows, an empty table
    none.  Of the alignments of one notice the best counts, of equal ones the first.
    Other columns are not read, whatever their names.
    """
    arrow_rows(docs.sparkSession)
    index = Index(base, notices)
    index.weigh(*document_counts(docs, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int32()), ("share", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            counts, places = index.match(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(places, kind)], names=["doc_id", "n_words", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, places {_PLACES}")


def digests(found: DataFrame) -> DataFrame:
    """The query's columns."""
    base = F.filter("places", lambda p: p["base"])
    listed = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform("base", lambda p: p["start"])
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(F.col("base")).alias("base_labels"), listed(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
