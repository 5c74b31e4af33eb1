"""Ids of texts through a table of their distinct chunks.

A text's ids are the ids of its chunks one after another. A new chunk is segmented once, and ids are joined
back by position: chunk numbers become lengths, cumulated offsets and one gather. The table is bounded, so a
worker's memory does not grow with the data: once full it keeps the chunks it has (frequent ones come early),
and later ones go into a second, smaller part that is emptied when it is full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tastemill.llm.textbytes import EXACT, spread, word_hashes

TABLE_CHUNKS = 200_000
TABLE_CHARS = 4_000_000


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        self.new.append(key)
        return at


class ChunkTable:
    """``segment`` gives the ids of each of a list of chunks, ``text_of`` the texts that lists of ids decode to."""

    def __init__(self, segment: Callable[[list[str]], list[list[int]]], max_chunks: int = TABLE_CHUNKS,
                 text_of: Callable[[list[str], list[list[int]]], list[str]] | None = None):
        self.segment, self.max_chunks, self.text_of = segment, max_chunks, text_of
        self.restart()

    def restart(self) -> None:
        self.numbers, self.chars, self.size = _Numbers(), 0, 0
        self.flat, self.bounds = np.zeros(1024, np.uint32), np.zeros(1, np.int64)
        self.kept: tuple[int, int] | None = None  # chunks and characters of the part that stays
        self.later: list[str] = []
        self.texts: list[str] = []  # decoded, by chunk number

    def _make_room(self) -> None:
        n, chars = len(self.numbers), self.chars
        if self.kept is None:
            if n >= self.max_chunks or chars >= TABLE_CHARS:
                self.kept = n, chars
        elif n > self.kept[0] + self.max_chunks // 2 or chars > self.kept[1] + TABLE_CHARS // 2:
            for chunk in self.later:
                del self.numbers[chunk]
            self.later = []
            self.bounds = self.bounds[:self.kept[0] + 1]
            self.size, self.chars = int(self.bounds[-1]), self.kept[1]
            del self.texts[self.kept[0]:]

    def _add(self, chunks: list[str]) -> None:
        found = self.segment(chunks)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        more = np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum()))
        if self.size + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(more)), np.uint32)])
        self.flat[self.size:self.size + len(more)] = more
        self.bounds = np.concatenate([self.bounds, self.size + np.cumsum(lengths)])
        self.size += len(more)
        self.chars += sum(map(len, chunks))
        if self.text_of:
            self.texts += self.text_of(chunks, found)
        if self.kept:
            self.later += chunks

    def join(self, chunks: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts of ``counts`` chunks each, where each text's begin and the last end, and the chunks' numbers."""
        self._make_room()
        at = np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))
        if self.numbers.new:
            self._add(self.numbers.new)
            self.numbers.new = []
        lengths = self.bounds[at + 1] - self.bounds[at]
        ids = self.flat[spread(self.bounds[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])], at


HASHED_WORDS = 500_000
HASHED_BYTES = 8_000_000


class _Part:
    """Words by 64-bit hash: sorted hashes, and for each word its bytes and ids in flat arrays."""

    def __init__(self):
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)] == hashes

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each word, compared by its bytes; -1 for a word that is not there."""
        row = np.full(len(hashes), -1)
        if len(self):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            found = self.rows[at[hit]]
            row[hit] = np.where(same_bytes(data, starts[hit], ends[hit], self.text, self.text_at[found], self.text_at[found + 1]), found, -1)
        return row

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Words whose sorted hashes are not there yet."""
        at, new = np.searchsorted(self.hashes, hashes), len(self) + np.arange(len(hashes))
        self.hashes, self.rows = np.insert(self.hashes, at, hashes), np.insert(self.rows, at, new)
        self.text = np.concatenate([self.text, data[spread(starts, ends - starts)]])
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + np.cumsum(ends - starts)])
        self.ids = np.concatenate([self.ids, ids])
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum(counts)])


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Which stretches of two byte arrays are the same."""
    size = a_end - a_start
    same = size == b_end - b_start
    kept = np.flatnonzero(same)
    differs = a[spread(a_start[kept], size[kept])] != b[spread(b_start[kept], size[kept])]
    wrong = np.flatnonzero(differs)
    same[kept[np.searchsorted(np.cumsum(size[kept]), wrong, "right")]] = False
    return same


class HashedTable:
    """Ids of words given as stretches of bytes, without a step per word outside numpy.

    The words of a slice of texts become distinct ones by a 64-bit hash and are looked up by it; bytes are always
    compared, and a word whose hash belongs to another is segmented by itself. Like ``ChunkTable`` the table is bounded:
    once full it stays, and later words go into a second part that is emptied when it is half as large.
    """

    def __init__(self, segment: Callable[[list[str]], list[list[int]]], max_words: int = HASHED_WORDS, max_bytes: int = HASHED_BYTES):
        self.segment, self.max_words, self.max_bytes = segment, max_words, max_bytes
        self.first, self.later = _Part(), _Part()

    def __len__(self) -> int:
        return len(self.first) + len(self.later)

    def _full(self, part: _Part, share: int) -> bool:
        return len(part) * share >= self.max_words or len(part.text) * share >= self.max_bytes

    def join(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's begin and the last end."""
        hashes = word_hashes(data, starts, ends, EXACT)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        lone = np.flatnonzero(~same_bytes(data, starts, ends, data, starts[first][which], ends[first][which]))
        if len(lone):  # words with the hash of another word
            first = np.concatenate([first, lone])
            which[lone] = len(distinct) + np.arange(len(lone))
        begin, end, n = starts[first], ends[first], len(distinct)
        if self._full(self.later, 2):
            self.later = _Part()
        old = self.first.find(distinct, data, begin[:n], end[:n])
        new = self.later.find(distinct, data, begin[:n], end[:n])
        missing = np.concatenate([np.flatnonzero((old < 0) & (new < 0)), np.arange(n, len(first))])
        ids = [self.first.ids, self.later.ids, np.zeros(0, np.uint32)]
        where = np.zeros((2, len(first)), np.int64)  # begin and number of ids, in the three arrays put together
        for rows, part, shift in ((old, self.first, 0), (new, self.later, len(ids[0]))):
            hit = np.flatnonzero(rows >= 0)
            where[0, hit], where[1, hit] = shift + part.ids_at[rows[hit]], np.diff(part.ids_at)[rows[hit]]
        if len(missing):
            raw = data.tobytes()
            found = self.segment([raw[a:b].decode() for a, b in zip(begin[missing].tolist(), end[missing].tolist())])
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids[2] = np.fromiter((i for own in found for i in own), np.uint32, int(counts.sum()))
            where[0, missing], where[1, missing] = len(ids[0]) + len(ids[1]) + np.cumsum(counts) - counts, counts
            part = self.later if self._full(self.first, 1) else self.first
            own = distinct[missing[missing < n]]
            keep = np.flatnonzero(~self.first.has(own) & ~self.later.has(own))  # of two words with one hash the table has one
            part.add(distinct[missing[keep]], data, begin[missing[keep]], end[missing[keep]], ids[2][spread((np.cumsum(counts) - counts)[keep], counts[keep])], counts[keep])
        size = where[1][which]
        return np.concatenate(ids)[spread(where[0][which], size)], np.concatenate([[0], np.cumsum(size)])
