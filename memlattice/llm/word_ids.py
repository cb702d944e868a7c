"""Token ids of whole texts through their distinct words.

A byte-level pre-tokenizer never joins a word to what stands before the single
space in front of it, nor an ASCII mark to the letter before it.  Text with plain
single separators thus falls apart into chunks whose ids do not depend on their
neighbours: each distinct chunk of a group of texts is encoded once, and arrays put
the ids of all texts together.  Any other text takes the whole-text path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at a time; one longer text is a group by itself.
GROUP_BYTES = 4 << 20
#: What the whole-text path takes: a separator at an end or beside another, any other white space or control character.
OTHER = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x{00}-\x{09}\x{0B}-\x{1F}\x{7F}-\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]"
#: A mark of its own in front of a chunk that follows its neighbour without a separator.
GLUE = "\x01"
MARKS = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_{|}~])"


class TwoGenerations:
    """Values by key; the generation before the last is forgotten, which bounds memory."""

    def __init__(self, limit: int = 200_000, longest: int = 64):
        self.limit, self.longest = limit, longest
        self.now: dict = {}
        self.older: dict = {}

    def missing(self, keys) -> list:
        """The keys without a value, after bringing older ones forward."""
        if len(self.now) > self.limit:
            self.older, self.now = {k: v for k, v in self.now.items() if len(k) <= self.longest}, {}
        now, older, out = self.now, self.older, []
        for key in keys:
            if key not in now:
                value = older.get(key)
                if value is None:
                    out.append(key)
                else:
                    now[key] = value
        return out


class KnownWords:
    """Packed ids of chunks, remembered; ``encode`` gives those of a list of chunks, 4 bytes an id."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode, self.known = encode, TwoGenerations()

    def __call__(self, chunks: list[str]) -> list[bytes]:
        absent = self.known.missing(chunks)
        now = self.known.now
        now.update(zip(absent, self.encode(absent), strict=True))
        return [now[chunk] for chunk in chunks]


def _prefixed(front: str, texts: pa.Array) -> pa.Array:
    front, none = (pa.scalar(x, pa.large_string()) for x in (front, ""))
    return pc.binary_join_element_wise(front, texts, none)


class WordEncoder:
    """Ids of a group of texts as one flat array with offsets.

    ``words`` gives the packed ids of a list of distinct chunks, each encoded by
    itself; ``wholes`` the ids of a list of any texts, to which those go that hold
    one of ``apart``.
    """

    def __init__(self, words: Callable[[list[str]], list[bytes]], wholes: Callable[[list[str]], list[np.ndarray]], line_feed: int, apart: tuple[str, ...] = ()):
        self.words, self.wholes, self.line_feed, self.apart = words, wholes, line_feed, apart

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Null and empty texts have no ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        held = pc.not_equal(texts, "")
        other = pc.match_substring_regex(texts, OTHER)
        for string in self.apart:
            other = pc.or_(other, pc.match_substring(texts, string))
        plain_at = np.flatnonzero(pc.and_not(held, other).to_numpy(zero_copy_only=False))
        other_at = np.flatnonzero(pc.and_(held, other).to_numpy(zero_copy_only=False))
        sizes = np.zeros(len(texts), dtype=np.int64)
        flat, sizes[plain_at] = self._plain(texts.take(pa.array(plain_at)))
        if not len(other_at):
            return flat, np.r_[0, np.cumsum(sizes)]
        found = self.wholes(texts.take(pa.array(other_at)).to_pylist())
        sizes[other_at] = [len(x) for x in found]
        ends = np.r_[0, np.cumsum(sizes)]
        out = np.empty(ends[-1], dtype=np.uint32)
        is_plain = np.zeros(len(texts), dtype=bool)
        is_plain[plain_at] = True
        out[np.repeat(is_plain, sizes)] = flat
        for at, ids in zip(other_at.tolist(), found, strict=True):
            out[ends[at] : ends[at + 1]] = ids
        return out, ends

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        chunks = pc.replace_substring_regex(texts, MARKS, rf"\1 {GLUE}\2")
        chunks = pc.replace_substring(_prefixed(GLUE, chunks), "\n", " \n")
        split = pc.split_pattern(chunks, " ")
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        at, kinds = coded.indices.to_numpy(), coded.dictionary
        line, glued = pc.starts_with(kinds, "\n"), pc.starts_with(kinds, GLUE)
        bare = pc.utf8_slice_codeunits(kinds, 1)
        forms = pc.if_else(pc.or_(line, glued), bare, _prefixed(" ", kinds))
        found = self.words(forms.to_numpy(zero_copy_only=False).tolist())
        front = self.line_feed.to_bytes(4, "little")
        for k in np.flatnonzero(line.to_numpy(zero_copy_only=False)).tolist():
            found[k] = front + found[k]
        n = np.fromiter(map(len, found), np.int32, len(found)) >> 2
        starts = (np.cumsum(n, dtype=np.int64) - n).astype(np.int32)
        upto = np.zeros(len(at) + 1, dtype=np.int64)
        each = n[at]
        np.cumsum(each, out=upto[1:])
        if upto[-1] >= 1 << 31:
            raise ValueError("a group of texts has more ids than an index holds")
        place = np.repeat(starts[at] - upto[:-1].astype(np.int32), each)
        place += np.arange(len(place), dtype=np.int32)
        flat = np.frombuffer(b"".join(found), dtype="<u4")[place]
        return flat, upto[bounds[1:]] - upto[bounds[:-1]]


def grouped(batches: Iterator[pa.RecordBatch], column: int, most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``most`` bytes of one column, at least a row each."""
    held, size = [], 0

    def together() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for row, length in enumerate(lengths.tolist()):
            if size and size + length > most:
                if row > start:
                    held.append(batch.slice(start, row - start))
                yield together()
                held, size, start = [], 0, row
            size += length
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield together()


def binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of slices of a flat array, without a copy of each."""
    data = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())
