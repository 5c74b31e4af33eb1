"""Importance resampling towards a target distribution, with bit-sliced sums of bucket gains.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of everything beyond ASCII. The features of a text are
its words and its pairs of neighbouring words, hashed into ``BUCKETS`` buckets by crc32. A bucket's gain is the scaled
log ratio of its smoothed share in the target to that in the source, a whole number; a document's weight is the mean
gain of its features, rounded down, and a noise drawn from its id makes the highest scores a weighted sample.

A document's sum of gains is taken bit by bit: bit i of its bucket counts is a plane of ``BUCKETS`` bits, and so is bit
j of the positive and of the negative gains. The bits two planes share, counted, weigh 2 ** (i + j); whole numbers
throughout, so the sums are exact however often a word comes.

Two passes over the texts: one for the counts of the buckets, of which every task emits its own sum, and one for the
weights. Only ids and numbers go on; scores are ranked in range partitions, each numbered by itself.

A null or empty text, or one without words, has no features and weight 0; it is never drawn if ``min_words`` is at
least 1. A null id draws its noise from the empty text and comes last among equals. Rows of one id are rows of their
own: equal ones have equal scores and ranks next to each other. Without target texts every bucket still has a gain.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm.registry import query, table
from tastemill.llm.textbytes import pieces, utf8, words
from tastemill.operators.numbering import dense_index
from tastemill.session import work_dir

BUCKETS = 10_000
PLANE_BYTES = -(-BUCKETS // 64) * 8
BLOCK = 256  # documents whose planes are made at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False

# ---------------------------------------------------------------- features

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_ALL = np.uint32(0xFFFFFFFF)
LONG_WORD = 64


def _step(state: np.ndarray, byte: np.ndarray | np.uint32) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def crc_states(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 registers after the bytes of each word, byte by byte for all words at once, from the given registers."""
    order = np.argsort(starts - ends, kind="stable")
    begin, size, state = starts[order], (ends - starts)[order], state[order]
    for k in range(min(LONG_WORD, int(size[0]) if len(size) else 0)):
        n = np.searchsorted(-size, -k)  # words longer than k
        state[:n] = _step(state[:n], data[begin[:n] + k])
    for k in range(np.searchsorted(-size, -LONG_WORD)):
        rest = data[begin[k] + LONG_WORD:begin[k] + size[k]].tobytes()
        state[k] = np.uint32(zlib.crc32(rest, int(state[k] ^ _ALL))) ^ _ALL
    out = np.empty_like(state)
    out[order] = state
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature, the text each belongs to, and words of each text."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    starts, ends, before = words(data, offsets, _APART)
    n_words = np.diff(before)
    text = np.repeat(np.arange(len(n_words)), n_words)
    one = crc_states(data, starts, ends, np.full(len(starts), _ALL))
    second = np.flatnonzero(text[1:] == text[:-1]) + 1
    two = crc_states(data, starts[second], ends[second], _step(one[second - 1], np.uint32(32)))
    return ((np.concatenate([one, two]) ^ _ALL) % np.uint32(BUCKETS)).astype(np.int64), np.concatenate([text, text[second]]), n_words


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket. A task emits a bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for piece in pieces(batches):
            total += np.bincount(features(piece.column(0))[0], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- gains and weights


def dense(counts: DataFrame) -> np.ndarray:
    """Counts by bucket; one row a bucket, so the driver gets at most ``BUCKETS`` rows."""
    out = np.zeros(BUCKETS, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of the smoothed shares in target and source, rounded down."""
    all_source, all_target = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target)))
                     for s, t in zip(source, target)], np.int64)


def _planes(member: np.ndarray) -> np.ndarray:
    """Rows of truth values by bucket as rows of 64-bit words."""
    return np.packbits(member, axis=1, bitorder="little").view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Signed weight and buckets of each bit of the positive gains, then of the negative ones."""
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gain, 0)
        for j in range(int(size.max()).bit_length()):
            member = np.zeros((1, PLANE_BYTES * 8), bool)
            member[0, :BUCKETS] = size >> j & 1
            out.append((sign << j, _planes(member)[0]))
    return out


def gain_sums(bucket: np.ndarray, text: np.ndarray, n_texts: int, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of the gains of each text's features, by planes of bits."""
    key, count = np.unique(text * BUCKETS + bucket, return_counts=True)
    text, bucket = np.divmod(key, BUCKETS)
    total = np.zeros(n_texts, np.int64)
    for low in range(0, n_texts, BLOCK):
        here = slice(*np.searchsorted(text, [low, low + BLOCK]))
        for i in range(int(count[here].max()).bit_length() if here.start < here.stop else 0):
            held = np.flatnonzero(count[here] >> i & 1) + here.start
            row_text, row = np.unique(text[held], return_inverse=True)
            member = np.zeros((len(row_text), PLANE_BYTES * 8), bool)
            member[row, bucket[held]] = True
            plane = _planes(member)
            for weight, wanted in planes:
                shared = np.bitwise_count(plane & wanted).sum(axis=1, dtype=np.int64)
                total[row_text] += (weight << i) * shared
    return total


def noise(key: object, seed: int) -> int:
    """Gumbel noise in thousandths, drawn from the seed and the id."""
    head = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((head + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_features, weight, score`` of every row, in one pass without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    planes = gain_planes(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            bucket, text, n_words = features(piece.column(1))
            n_features = n_words + np.maximum(n_words - 1, 0)
            weight = gain_sums(bucket, text, len(n_words), planes) // np.maximum(n_features, 1)
            score = weight + np.array([noise(k, seed) for k in piece.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score))],
                names=[key, "n_words", "n_features", "weight", "score"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """Weights and scores of every document, and the rank of the drawn ones.

    Of the documents with at least ``min_words`` words the ``percent`` of a hundred with the highest scores are drawn,
    ties to the smaller id.
    """
    spark = docs.sparkSession
    gain = gains(dense(bucket_counts(docs)), dense(bucket_counts(target)))
    folder = work_dir(spark, "weights")
    # Rows of one id and score are told apart by their place in the file, so that they need not share a partition.
    weigh(docs, gain, seed, key).withColumn("place", F.monotonically_increasing_id()).write.parquet(folder)
    scored = spark.read.parquet(folder)
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = F.struct((-F.col("score")).alias("short"), F.col(key).isNull().alias("none"), F.col(key).alias("id"), "place")
    rank = F.col("index") + 1
    ranked = dense_index(able.withColumn("order", order), "order", "index").withColumn("rank", F.when(rank <= drawn, rank))
    names = [key, "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*names).unionByName(rest.select(*names))


# Distinct features keep their crc32, taken byte by byte over the table of the polynomial.
_SQL = """
WITH RECURSIVE bits(k, n, c) AS (
    SELECT 0, i, i FROM range(256) r(i)
    UNION ALL SELECT k + 1, n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
source AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
    FROM documents),
target AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
    FROM benchmark),
ours AS (
    SELECT r, unnest(w) AS f FROM source
    UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM source),
theirs AS (
    SELECT unnest(w) AS f FROM target
    UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM target),
hashed AS (
    SELECT f, xor(list_reduce(
        list_transform(range(length(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM (SELECT f FROM ours UNION ALL SELECT f FROM theirs)), crc),
counted AS (SELECT r, bucket, count(*) AS n FROM ours JOIN hashed USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(n)::DOUBLE AS n FROM counted GROUP BY 1),
t AS (SELECT bucket, count(*)::DOUBLE AS n FROM theirs JOIN hashed USING (f) GROUP BY 1),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
        / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS g
    FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT r, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM counted JOIN gain USING (bucket) GROUP BY 1),
scored AS (
    SELECT doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM source LEFT JOIN weight USING (r)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
        25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn
    FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank
FROM placed
"""


@query("op12_importance_resampling", _SQL)
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
