"""Documents as token sequences of fixed length with little padding, by minimum bin slack.

A document's ids are cut into windows of ``CAPACITY``; the last piece keeps what is left. Only the numbers of
pieces by length are brought together (at most ``CAPACITY`` numbers, whatever the data). A window is planned
from them: it takes the longest piece left, and a subset-sum over the counts of all other lengths, kept as one
bitset after each length, finds the filling closest to the capacity; going back through the bitsets gives how
many pieces of each length it takes. The filling is used as often as the counts allow, so there are few
different ones. A length that no filling brings within ``SLACK`` of the capacity is left over.

Pieces then find their place by themselves: they are numbered within their length, and the plan is a short
table of number ranges. Numbers are made in buckets of a hash, so a length that a third of all pieces share
is not one task's work. Left over pieces (few, unless one length is very common) are laid end to end and cut
once more at every window, so only the last sequence has more than ``SLACK`` of padding.

Null and empty texts are a piece of the end id alone. Repeated documents are packed like others; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastemill.llm.chunk_table import ChunkTable, HashedTable
from tastemill.llm.registry import query, table
from tastemill.llm.textbytes import pieces as slices
from tastemill.llm.textbytes import spread, utf8
from tastemill.session import work_dir

CAPACITY = 2048
SLACK = 4
END_ID = 1
# In texts of these signs alone the tokenizer's split is plain: runs of letters, single digits, runs of other signs.
# The apostrophe is not among them because it begins suffixes, nor are letters that change when composed.
_BLANK, _LETTER, _DIGIT, _SIGN, _ELSE = range(5)
_CLASS = np.full(256, _ELSE, np.uint8)
_CLASS[[*range(33, 39), *range(40, 127)]] = _SIGN
_CLASS[[9, 10, 13, 32]] = _BLANK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_LEAD = 0xC3  # of the two bytes of À to ÿ, all letters but × and ÷
_NO_LETTER = (0x97, 0xB7)


class WordIds:
    """Ids by a tokenizer that drops white space and case and never joins what stands on the two sides of a blank.

    Plain texts are cut into words on their bytes and looked up by hash; the others are cut at white space.
    """

    def __init__(self, vocabulary: str, **limits: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks_of = re.compile("[^ \n\t\r]+").findall
        self.words = HashedTable(self._tokenize, **limits)
        self.chunks = ChunkTable(self._tokenize)

    def _tokenize(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which texts are plain, and the class of every byte of theirs."""
        kind = _CLASS[data]
        lead = np.flatnonzero(data == _LEAD)
        kind[lead] = kind[lead + 1] = np.where(np.isin(data[lead + 1], _NO_LETTER), _SIGN, _LETTER)
        other = np.concatenate([[0], np.cumsum(kind == _ELSE)])
        plain = other[offsets[1:]] == other[offsets[:-1]]
        raw = data.tobytes()
        for special in self.specials:
            at = raw.find(special)
            while at >= 0:
                plain[np.searchsorted(offsets, at, "right") - 1] = False
                at = raw.find(special, at + 1)
        return plain, kind

    def _of_plain(self, data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower = data.copy()
        lower[(data >= 65) & (data < 91)] += 32
        after = np.flatnonzero(data == _LEAD) + 1
        upper = after[(data[after] < 0x9F) & (data[after] != _NO_LETTER[0])]
        lower[upper] += 32
        edge = np.ones(len(kind) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        word = kind[starts] != _BLANK if len(starts) else np.zeros(0, bool)
        starts, ends = starts[word], ends[word]
        ids, bounds = self.words.join(lower, starts, ends)
        return ids, bounds[np.searchsorted(starts, offsets)]

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin and the last end; null is empty."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        data, offsets = utf8(column)
        plain, kind = self._plain(data, offsets)
        size, at = np.diff(offsets), np.flatnonzero(plain)
        if len(at) < len(plain):
            own = spread(offsets[at], size[at])
            ids, bounds = self._of_plain(data[own], kind[own], np.concatenate([[0], np.cumsum(size[at])]))
        else:
            ids, bounds = self._of_plain(data, kind, offsets)
            return ids, bounds
        rest = np.flatnonzero(~plain)
        cut = [self.chunks_of(text) for text in column.take(pa.array(rest)).to_pylist()]
        more, more_bounds, _ = self.chunks.join([c for own in cut for c in own], [len(own) for own in cut])
        begin, count = np.empty(len(plain), np.int64), np.empty(len(plain), np.int64)
        begin[at], count[at] = bounds[:-1], np.diff(bounds)
        begin[rest], count[rest] = len(ids) + more_bounds[:-1], np.diff(more_bounds)
        return np.concatenate([ids, more])[spread(begin, count)], np.concatenate([[0], np.cumsum(count)])


@cache
def _word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces: where they start, their length, the checksum of their ids and the document's length.

    ``text_hash`` tells documents with one id apart.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(vocabulary)
        for piece in slices(batches):
            ids, bounds = words.encode(piece.column(1))
            row, start, length, crc, total = [], [], [], [], []
            for k in range(piece.num_rows):
                own = np.append(ids[bounds[k]:bounds[k + 1]], END_ID).astype("<u4")
                for at in range(0, len(own), capacity):
                    part = own[at:at + capacity]
                    row.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    total.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c).take(pa.array(row, pa.int64())) for c in (0, 2)),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                names=["doc_id", "text_hash", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, f"doc_id {kind}, text_hash long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """How many pieces of each length the next window takes; ``counts`` has the pieces left by length."""
    longest = int(np.flatnonzero(counts)[-1])
    room, taken = capacity - longest, {longest: 1}
    keep, whole = (1 << (room + 1)) - 1, 1 << room
    reach, stages = 1, []
    for length in range(min(longest, room), 0, -1):
        left = min(int(counts[length]) - (length == longest), room // length)
        if left <= 0:
            continue
        stages.append((length, left, reach))
        step = 1
        while left:  # any number up to ``left`` as sums of 1, 2, 4, …
            step = min(step, left)
            reach |= reach << (length * step) & keep
            left -= step
            step *= 2
        if reach & whole:
            break
    target = reach.bit_length() - 1
    for length, left, before in reversed(stages):
        used = next(m for m in range(left + 1) if target >= m * length and before >> (target - m * length) & 1)
        if used:
            taken[length] = taken.get(length, 0) + used
        target -= used * length
    return taken


def plan(counts: np.ndarray, capacity: int = CAPACITY, slack: int = SLACK) -> tuple[list[tuple], list[tuple], int]:
    """Rows (length, first number, end number, pieces in a window, first window, offset in the window), then rows
    (length, first number, place of the first left over piece in the line of them all), and the number of windows.

    Of the pieces of a length, those with numbers from the first up to the end go to the windows from the
    first on, so many to each; those after the last end are left over.
    """
    counts, given = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    rows, left, window, line = [], [], 0, 0
    while counts.any():
        taken = fill(counts, capacity)
        if sum(length * n for length, n in taken.items()) < capacity - slack:
            longest = max(taken)
            left.append((longest, int(given[longest]), line))
            line += longest * int(counts[longest])
            counts[longest] = 0
            continue
        times = min(int(counts[length]) // n for length, n in taken.items())
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            rows.append((length, int(given[length]), int(given[length]) + times * n, n, window, offset))
            given[length] += times * n
            counts[length] -= times * n
            offset += length * n
        window += times
    return sorted(rows), sorted(left), window


def numbered(pieces: DataFrame, buckets: int) -> DataFrame:
    """``number`` of each piece among those of its length, from 0."""
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets))
    rows = pieces.withColumn("bucket", bucket)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "text_hash")
    return rows.withColumn("at", F.row_number().over(own)).join(sizes, ["length", "bucket"]).withColumn(
        "number", F.col("before") + F.col("at") - 1).drop("bucket", "at", "before")


def _placed(pieces: DataFrame, rows: list[tuple], left: list[tuple]) -> DataFrame:
    """``sequence_id`` and ``offset`` of planned pieces; ``line`` of those left over, their place in the line."""
    names = [c for c in pieces.columns if c != "number"]
    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names)
    rows = np.array([(0, 0, 0, 1, 0, 0), *rows], np.int64)
    left = np.array([(0, 0, 0), *left], np.int64)
    keys, left_keys = rows[:, 0] << 48 | rows[:, 1], left[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            _, first, _, each, window, offset = rows[np.searchsorted(keys, length << 48 | number, side="right") - 1].T
            left_length, left_first, start = left[np.searchsorted(left_keys, length, side="right") - 1].T
            over = (left_length == length) & (number >= left_first)
            at = number - first
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(window + at // each, mask=over),
                 pa.array(offset + at % each * length, mask=over),
                 pa.array(start + (number - left_first) * length, mask=~over), pa.array(over)],
                names=[*names, "sequence_id", "offset", "line", "left_over"])

    return pieces.mapInArrow(run, f"{kinds}, sequence_id long, offset long, line long, left_over boolean")


def _cut_again(docs: DataFrame, left: DataFrame, vocabulary: str, capacity: int, window: int) -> DataFrame:
    """Left over pieces in line, cut at every multiple of the capacity; sequences are numbered from ``window``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).alias("d")

    def same(other: str):
        return (F.col("d.text_hash") == F.col(f"{other}.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id"))

    wanted = hashed.join(left.alias("w"), same("w"), "left_semi").dropDuplicates(["doc_id", "text_hash"]).alias("d")
    rows = wanted.join(left.alias("l"), same("l")).select("d.doc_id", "d.text", "l.start", "l.length", "l.doc_tokens", "l.line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(vocabulary)
        for piece in slices(batches):
            ids, bounds = words.encode(piece.column(1))
            out = []
            for k, (start, length, total, line) in enumerate(zip(*(piece.column(c).to_pylist() for c in range(2, 6)))):
                own = np.append(ids[bounds[k]:bounds[k + 1]], END_ID).astype("<u4")
                at = 0
                while at < length:
                    n = min(length - at, capacity - (line + at) % capacity)
                    out.append((k, start + at, n, zlib.crc32(own[start + at:start + at + n]), total,
                                window + (line + at) // capacity, (line + at) % capacity))
                    at += n
            row, *columns = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in columns)], names=NAMES)

    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in NAMES[1:]))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. Pieces are kept in the shared folder, so texts are tokenized once."""
    spark = docs.sparkSession
    place = work_dir(spark, "pieces")
    token_pieces(docs, vocabulary, capacity).write.parquet(f"{place}/cut")
    pieces = spark.read.parquet(f"{place}/cut")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    rows, left, window = plan(counts, capacity, slack)
    placed = _placed(numbered(pieces, int(spark.conf.get("spark.sql.shuffle.partitions"))), rows, left)
    if not left:
        return placed.select(*NAMES)
    # Kept apart on disk, so that Spark knows how small the left over part is when it joins it with the texts.
    placed.write.partitionBy("left_over").parquet(f"{place}/placed")
    done = spark.read.schema(placed.schema).parquet(f"{place}/placed")
    return done.where("not left_over").select(*NAMES).unionByName(
        _cut_again(docs, done.where("left_over"), vocabulary, capacity, window))


@query("op5_packing")
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
