"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words of a text that repeats with smallest period q at least twice over and cannot be extended
either way. Texts of a slice are handled together:

1. Words become numbers, and prefix doubling sorts the suffixes of every text. Level k of the doubling names the class of
   each stretch of 2**k words, and the class is an interval of the suffix array. Texts in which no six words come twice
   cannot hold a run of 12 words and leave after level 2.
2. A wavelet tree over the suffix array answers range successor queries: the next occurrence of a stretch after a place.
3. Every text is cut into dyadic blocks of 4, 8, 16, … words. A run whose period is at least 2 * 2**k - 1 (any up to 14 for
   the blocks of 4) has a block of level k that comes again one period later. Each block asks for its occurrences in the window
   behind it that the periods of its level span. Occurrences closer than half a block form a progression: the
   block itself is periodic there. A progression is passed in one step to the end of its periodic stretch, and gives the
   candidates that align it with the block's own stretch. All other occurrences are candidates themselves.
4. Common extensions, read from the classes, tell how far each candidate period holds on both sides.

A block has at most a handful of occurrences and progressions in its window, so the work grows with the words times
the number of levels whatever the text repeats.

Words are runs of bytes other than ASCII white space and compare byte by byte: they are numbered by 64-bit hashes, and a
text with runs whose hashes collide is done again with exact numbers. A null or empty text has no words and no runs.
Repeated rows are rows of their own with equal results. An empty table gives no rows; other columns are not looked
at. One text is handled by one task, with some hundred bytes a word if it repeats itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm.registry import query, table
from tastemill.llm.textbytes import EXACT, pieces, spread, utf8, word_hashes, words

LEAST = 12  # words of the shortest run
LOWEST = 2  # level of the smallest blocks

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, length, period


class Classes:
    """Classes of all stretches of 2**k words by prefix doubling, and the suffix array they end in.

    ``names[k][i]`` is the first place in the suffix array of the class of the 2**k words from i on; a stretch that
    would leave its text is alone in its class. ``shared[k]`` are the places whose class has other members.
    """

    def __init__(self, numbers: np.ndarray, bounds: np.ndarray, most: int | None = None):
        """``most`` stops at that level."""
        n = len(numbers)
        self.n = n
        ends = np.repeat(bounds[1:], np.diff(bounds))
        self.names: list[np.ndarray] = []
        self.shared: list[np.ndarray] = []
        name, step = np.zeros(n, np.int64), 0
        todo, second = np.arange(n), numbers.astype(np.int64)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        second = text * (int(second.max(initial=0)) + 1) + second
        while True:
            order = np.lexsort((second, name[todo])) if step else np.argsort(second, kind="stable")
            at, first, then = todo[order], name[todo][order], second[order]
            of_class, of_name = np.ones(len(at), bool), np.ones(len(at), bool)
            of_class[1:] = first[1:] != first[:-1]
            of_name[1:] = of_class[1:] | (then[1:] != then[:-1])
            place = np.arange(len(at))
            class_at = np.maximum.accumulate(np.where(of_class, place, 0))
            name_at = np.maximum.accumulate(np.where(of_name, place, 0))
            name = name.copy()
            name[at] = first + name_at - class_at
            alone = of_name & np.append(of_name[1:], True)
            todo = np.sort(at[~alone])
            self.names.append(name.astype(np.int32))
            self.shared.append(todo)
            if not len(todo) or len(self.names) - 1 == most:
                return
            step = 2 * step or 1
            inside = todo + step < ends[todo]
            second = np.where(inside, name[np.minimum(todo + step, n - 1)] + 1, 0)

    def suffixes(self) -> np.ndarray:
        order = np.empty(self.n, np.int64)
        order[self.names[-1]] = np.arange(self.n)
        return order

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are the same from i and from j > i on."""
        far = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names) - 1)):
            name, right = self.names[k], j + far
            same = (right < self.n) & (name[np.minimum(i + far, self.n - 1)] == name[np.minimum(right, self.n - 1)])
            far += same.astype(np.int64) << k
        return far

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are the same before i and before j > i."""
        far = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names) - 1)):
            left = i - far - (1 << k)
            right = np.minimum(j - far - (1 << k), self.n - 1)
            same = (left >= 0) & (self.names[k][np.maximum(left, 0)] == self.names[k][np.maximum(right, 0)])
            far += same.astype(np.int64) << k
        return far


class Successor:
    """A wavelet tree over an array of whole numbers: for each bit, from the highest, how many zeros are before a place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(values.max(initial=0)).bit_length(), 1)
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def _walk(self, low: np.ndarray, high: np.ndarray, goes: Callable) -> None:
        for bit, before in zip(reversed(range(self.bits)), self.zeros):
            low0, high0 = before[low].astype(np.int64), before[high].astype(np.int64)
            one = goes(bit, high0 - low0)
            low = np.where(one, before[-1] + low - low0, low0)
            high = np.where(one, before[-1] + high - high0, high0)

    def __call__(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``least`` among the places low to high of the array, or -1."""
        smaller = np.zeros(len(low), np.int64)
        capped = np.minimum(least, (1 << self.bits) - 1)

        def count(bit: int, zeros: np.ndarray) -> np.ndarray:
            one = (capped >> bit & 1).astype(bool)
            smaller[one] += zeros[one]
            return one

        self._walk(low, high, count)
        found = (smaller < high - low) & (least == capped)
        left, value = np.where(found, smaller, 0), np.zeros(len(low), np.int64)

        def select(bit: int, zeros: np.ndarray) -> np.ndarray:
            one = left >= zeros
            left[one] -= zeros[one]
            value[one] |= 1 << bit
            return one

        self._walk(low, high, select)
        return np.where(found, value, -1)


def _candidates(classes: Classes, after: Successor, k: int, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and candidate periods from the blocks of level k."""
    size = 1 << k
    low_q, high_q = (1, 4 * size - 2) if k == LOWEST else (2 * size - 1, 4 * size - 2)
    name, shared = classes.names[k], classes.shared[k]
    members = np.bincount(name[shared], minlength=classes.n)
    block = shared[(shared - starts[shared]) % size == 0]
    if k == LOWEST:  # the one period that the window behind can miss, in a run of 12 words
        first = block[block - 6 >= starts[block]]
        first = first[name[first - 6] == name[first]] - 6
        yield first, np.full(len(first), 6)
    low = name[block]
    high = low + members[low]
    at = block
    while len(block):
        found = after(low, high, at + 1)
        live = (found >= 0) & (found - block <= high_q)
        block, low, high, at, found = block[live], low[live], high[live], at[live], found[live]
        far = found - block >= low_q
        yield block[far], (found - block)[far]
        p = found - at
        near = np.flatnonzero(p <= size // 2)
        x, y, p, own = block[near], at[near], p[near], block[near] == at[near]
        right = y + p + classes.ahead(y, y + p)  # the stretch of period p around the occurrence
        left = y - classes.back(y, y + p)
        at = found.copy()
        at[near] = right - size
        x, y, p, left, right = x[~own], y[~own], p[~own], left[~own], right[~own]
        if len(x):  # another stretch than the block's own
            begin, end = x - classes.back(x, x + p), x + p + classes.ahead(x, x + p)
            for q in (left - begin, right - end):
                fits = (q >= low_q) & (q <= high_q)
                yield x[fits], q[fits]
            touch = np.flatnonzero(end >= left)
            terms = (np.minimum(right[touch] - size - x[touch], high_q) - (y - x)[touch]) // p[touch] + 1
            terms = np.maximum(terms, 0)
            row = np.repeat(touch, terms)
            q = (y - x)[row] + spread(np.zeros(len(touch), np.int64), terms) * p[row]
            whole = np.minimum(end[row], right[row] - q) - np.maximum(begin[row], left[row] - q) + q
            fits = (q >= low_q) & (whole >= np.maximum(LEAST, 2 * q))
            yield x[row][fits], q[fits]


def _none() -> Runs:
    return tuple(np.zeros(0, np.int64) for _ in range(3))


def find_runs(numbers: np.ndarray, bounds: np.ndarray) -> Runs:
    """Runs in texts of numbered words, ``bounds`` being where each begins and the last ends; by start, then period."""
    if not len(numbers):
        return _none()
    lengths = np.diff(bounds)
    start_of, end_of = (np.repeat(b, lengths) for b in (bounds[:-1], bounds[1:]))
    first = Classes(numbers, bounds, LOWEST)
    if len(first.names) <= LOWEST:
        return _none()
    place = first.shared[LOWEST]
    name = first.names[LOWEST]
    place = place[place + 6 <= end_of[place]]
    six = name[place].astype(np.int64) * len(numbers) + name[place + 2]
    order = np.argsort(six, kind="stable")
    again = np.flatnonzero(six[order][1:] == six[order][:-1])
    text = np.repeat(np.arange(len(lengths)), lengths)
    keep = np.unique(text[place[order[again]]])
    if not len(keep):
        return _none()
    if len(keep) < len(lengths):
        moved = np.concatenate([[0], np.cumsum(lengths[keep])])
        start, length, period = find_runs(numbers[spread(bounds[keep], lengths[keep])], moved)
        of = np.searchsorted(moved, start, "right") - 1
        return start - moved[of] + bounds[keep][of], length, period

    classes = Classes(numbers, bounds)
    after = Successor(classes.suffixes())
    found = [c for k in range(LOWEST, len(classes.names) - 1) for c in _candidates(classes, after, k, start_of, end_of)]
    if not found:
        return _none()
    at, q = (np.concatenate(x) for x in zip(*found))
    whole = at + q <= end_of[at]
    key = np.unique(at[whole] * (len(numbers) + 1) + q[whole])
    at, q = np.divmod(key, len(numbers) + 1)
    start = at - classes.back(at, at + q)
    length = at + q + classes.ahead(at, at + q) - start
    long = length >= np.maximum(LEAST, 2 * q)
    start, length, q = start[long], length[long], q[long]
    order = np.lexsort((q, length, start))  # of one stretch the smallest period
    start, length, q = start[order], length[order], q[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[smallest], length[smallest], q[smallest]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def planted(key: object, n: int) -> tuple[int, int] | None:
    """From which word on, and with which period, a text of n words repeats itself by its id; None for most ids."""
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _texts(piece: pa.RecordBatch, plant: bool) -> Iterator[tuple[int, Runs, list[bytes]]]:
    """Words of each text, its runs and the words left after dropping repetitions."""
    data, offsets = utf8(piece.column(1))
    begin, end, before = words(data, offsets)
    lengths = np.diff(before)
    index = np.arange(len(begin))
    changed = [planted(key, int(n)) for key, n in zip(piece.column(0).to_pylist(), lengths)] if plant else [None] * len(lengths)
    for k, change in enumerate(changed):
        if change:
            own = slice(before[k] + change[0], before[k + 1])
            index[own] = own.start + np.arange(own.stop - own.start) % change[1]
    numbers = np.unique(word_hashes(data, begin, end, EXACT), return_inverse=True)[1][index]
    runs = find_runs(numbers, before)
    mark = np.searchsorted(runs[0], before)
    for k, (n, change) in enumerate(zip(lengths, changed)):
        found = data[offsets[k]:offsets[k + 1]].tobytes().split()
        if change:
            found = [found[i] for i in index[before[k]:before[k + 1]] - before[k]]
        own = tuple(x[mark[k]:mark[k + 1]] - (before[k] if x is runs[0] else 0) for x in runs)
        if len(own[0]):
            exact = np.unique(np.array(found, object), return_inverse=True)[1]
            if exact.max() + 1 != len(np.unique(numbers[before[k]:before[k + 1]])):  # two words with one hash
                own = find_runs(exact, np.array([0, n]))
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, own[0] + own[2], 1)
            np.add.at(cover, own[0] + own[1], -1)
            found = [found[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
        yield int(n), own, found


def periodic_runs(docs: DataFrame, key: str = "doc_id", plant: bool = False) -> DataFrame:
    """``key, n_words, runs, collapsed`` of every row, in one pass without a shuffle.

    Runs are structs of ``start, length, period`` in words, by start, then period; ``collapsed`` joins by one blank the
    words that no run repeats. ``plant`` first makes texts with certain ids repeat themselves.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            n, runs, kept = zip(*_texts(piece, plant))
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])]), pa.int32())
            fields = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*runs)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
                 pa.array([b" ".join(k) for k in kept], pa.binary()).cast(pa.string())],
                names=[key, "n_words", "runs", "collapsed"])

    return docs.select(key, "text").mapInArrow(
        run, f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(table(spark, folder, "documents"), plant=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    period = -F.col("best.period")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("best.length") / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
