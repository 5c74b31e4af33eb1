"""Texts of Arrow batches as bytes, words and word hashes in numpy.

Batches are cut so that one piece holds about ``PIECE_BYTES`` of text (one longer text makes a piece of
its own): the arrays stay in the cache and a task's memory does not depend on how many rows it gets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# A number for each byte.
EXACT = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))

# The same for both cases of an ASCII letter.
_LETTER = np.arange(256, dtype=np.uint64)
_LETTER[65:91] += np.uint64(32)
_LETTER = mix((_LETTER + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to ``n``, kept between calls."""
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
                        for b in (BASE, _INVERSE))
    return _powers


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(start, end - start)
    pa.default_memory_pool().release_unused()  # workers live on after a task and would keep the memory of its batches


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins and the last ends; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, a run of bytes other than those ``apart`` (ASCII white space), and words before each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = apart[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = _LETTER) -> np.ndarray:
    """64 bits for each word; ASCII letters count without case, unless ``letters`` tells them apart."""
    power, inverse = _power_tables(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(letters[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … (counts[0] of them), then the same for the next."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text, and where each text's begin and the last end.

    A text of fewer words has one shingle of all of them; a text without words has none.
    """
    data, offsets = utf8(column)
    starts, ends, before = words(data, offsets)
    hashed = word_hashes(data, starts, ends)
    n_words = np.diff(before)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    at = spread(before[:-1], counts)
    left = np.repeat(before[1:], counts) - at  # words from the shingle's first to the end of its text
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashed, np.zeros(width, np.uint64)])
    for k in range(width):
        factor = np.uint64((BASE * (2 * k + 3) ** 7 | 1) & (2 ** 64 - 1))
        word = padded[at + k] * factor
        total += word if k == 0 else np.where(left > k, word, np.uint64(k))
    return mix(total), np.concatenate([[0], np.cumsum(counts)])
