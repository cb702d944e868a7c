"""Word shingles of texts and their hashes, in bounded memory.

Words are runs of bytes other than x20 and x09-x0D, with A-Z lowered.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes that are hashed at a time; longer texts are cut between words.
PIECE = 1 << 20

_FACTOR, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the factor and its inverse modulo 2 ** 64, as many as a piece needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.up, self.down
        if len(up) < n:
            up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n, f, dtype=np.uint64)]) for f in (_FACTOR, _INVERSE))
            if n <= 2 * PIECE:  # what a word longer than a piece needs is not kept
                self.up, self.down = up, down
        return up[:n], down[:n]


_POWERS = _Powers()


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word number of all shingles.

    A text of fewer words has one shingle of them all, one without words none.
    """
    found, group, first, size = [], [], 0, 0
    for k, text in enumerate(texts):
        if size + len(text) > PIECE and group:
            found.append(_hashed(group, words, first))
            group, first, size = [], k, 0
        if len(text) > PIECE:
            found.extend(_pieces(text, words, k))
            first = k + 1
            continue
        group.append(text)
        size += len(text) + 1
    if group:
        found.append(_hashed(group, words, first))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate([n, *(f[c] for f in found)]) for c, n in enumerate(none))


def _pieces(text: bytes, words: int, number: int):
    """The shingles of a long text from pieces that share ``words`` - 1 words."""
    start, before = 0, 0
    while start < len(text):
        end = start + PIECE
        data = np.frombuffer(text, dtype=np.uint8, count=min(PIECE, len(text) - start), offset=start)
        spaces = np.flatnonzero(_SPACE[data])
        if end >= len(text):
            end, next_start = len(text), len(text)
        else:
            edges = spaces[:-1][np.diff(spaces) > 1] if len(spaces) > 1 else spaces[:0]  # a word starts after each
            if len(edges) > words:
                # The next piece starts with the last words - 1 words that end in this one.
                end, next_start = start + int(spaces[-1]), start + int(edges[-(words - 1)]) + 1 if words > 1 else start + int(spaces[-1])
            else:  # words longer than a piece: take the rest as one
                end, next_start = len(text), len(text)
        hashes, _, at = _hashed([text[start:end]], words, number)
        if before and len(at) == 1 and len(text[start:end].split()) < words:
            break  # nothing but the words shared with the piece before
        yield hashes, np.full(len(hashes), number), at + before
        before += len(hashes)
        start = next_start


def _hashed(texts: list[bytes], words: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By one pass over the bytes; texts are numbered from ``number``."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.r_[True, space].view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])
    upto = np.r_[np.uint64(0), sums]
    word = mix((upto[ends] - upto[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) << np.uint64(48))
    borders = np.cumsum([len(t) + 1 for t in texts])
    text_of = np.searchsorted(borders, starts, side="right")
    first = np.searchsorted(text_of, np.arange(len(texts) + 1))
    step = np.uint64(0xD6E8FEB86659FD93)
    n = max(0, len(word) - words + 1)
    full = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        full = full * step + word[k : k + n]
    inside = np.flatnonzero(text_of[:n] == text_of[words - 1 : words - 1 + n]) if n else np.zeros(0, dtype=np.int64)
    hashes, owner, at = [full[inside]], [text_of[inside]], [inside - first[text_of[inside]]]
    counts = np.diff(first)
    for short in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        h = np.zeros(1, dtype=np.uint64)
        for k in range(first[short], first[short + 1]):
            h = h * step + word[k : k + 1]
        hashes.append(h)
        owner.append(np.array([short]))
        at.append(np.array([0]))
    return mix(np.concatenate(hashes)), np.concatenate(owner) + number, np.concatenate(at)


def hashes_by_text(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    hashes, owner, _ = shingle_hashes(texts, words)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    hashes = hashes[order]
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def shingles(text: bytes, words: int = WORDS) -> list[bytes]:
    found = text.lower().split()
    return [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
