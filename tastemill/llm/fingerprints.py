"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of the hash range is kept.

The fraction is the same for all documents, so a sketch grows with its document, the sketch of a union is the
union of the sketches, and the share of one sketch found in another estimates containment however unequal the
documents are. Shingles are five words (ASCII white space between, ASCII letters without case).

A document none of whose hashes is below the fraction keeps its smallest hash instead, so that equal short
texts are alike, and it survives merging (the smallest hash of a union is the smaller of the two).

What an estimate rests on is ``support``, the number of a document's hashes below the fraction, about
``FRACTION`` of its shingles. With a support of at least one, the estimated containment of a part in its whole is
1 whatever their sizes, and that of a true containment c errs by about sqrt(c (1 - c) / support). Without support,
for n shingles in (1 - FRACTION) ** n of all cases, a sketch cannot say whether the document lies in a longer one:
its containment is then 1 in itself and in texts that share its smallest hash as theirs, else 0.

A fingerprint is the base64 text of the sorted 48-bit hashes, six bytes each. Null and empty texts, and texts
of white space, have the empty fingerprint; two of these are fully alike, and nothing is like only one of
them. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm.registry import query, table
from tastemill.llm.textbytes import pieces, shingles

FRACTION = 1 / 4
HASH_BITS = 48
WIDTH = 5


def limit_of(fraction: float) -> int:
    return int(fraction * (1 << HASH_BITS))


def sketches(column: pa.Array, fraction: float = FRACTION, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct kept hashes of each text."""
    hashes, bounds = shingles(column, width)
    hashes >>= np.uint64(64 - HASH_BITS)
    below = hashes < np.uint64(limit_of(fraction))
    kept, kept_before = hashes[below], np.concatenate([[0], np.cumsum(below)])[bounds]
    found = []
    for k in range(len(column)):
        own = kept[kept_before[k]:kept_before[k + 1]]
        if len(own):
            found.append(np.unique(own))
        elif bounds[k] < bounds[k + 1]:
            found.append(hashes[bounds[k]:bounds[k + 1]].min(keepdims=True))
        else:
            found.append(own)
    return found


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Sketch of two documents together."""
    both = np.union1d(a, b)
    below = both[both < np.uint64(limit_of(fraction))]
    return below if len(below) else both[:1]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def support(sketch: np.ndarray, fraction: float = FRACTION) -> int:
    """Number of the hashes an estimate rests on; 0 where a document is too short to be found in longer ones."""
    return int(np.searchsorted(sketch, np.uint64(limit_of(fraction))))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first document's shingles that the second has."""
    if not len(a):
        return float(not len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many first characters of the following one, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def ranges(docs: DataFrame, n: int, key: str) -> list[int]:
    """Up to ``n - 1`` cut points that deal the keys into ranges of about equal counts; the key must be whole numbers."""
    cuts = docs.approxQuantile(key, [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []
    return sorted({int(c) for c in cuts})


def with_following(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id``, ``text`` and the shard of each row, plus a copy of the rows with each shard's first id in the shard before.

    Texts travel once: the shard is a function of the id, and the copied rows (one id a shard) are known before.
    """
    docs = docs.select("doc_id", "text")
    cuts = ranges(docs, n, "doc_id")
    at = _bucket(F.col("doc_id"), cuts) if cuts else F.lit(0)
    placed = docs.withColumn("shard", at.cast("int"))
    firsts = placed.groupBy("shard").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first")).collect()
    firsts = sorted((r["shard"], r["first"][1]) for r in firsts)  # one row a shard
    before = {first: shard for (shard, _), (_, first) in zip(firsts, firsts[1:])}
    if not before:
        return placed.withColumn("copied", F.lit(False))
    previous = F.create_map(*[F.lit(x) for first, shard in before.items() for x in (first, shard)])[F.col("doc_id")]
    return placed.withColumn("to", F.explode(F.array_compact(F.array(
        F.struct(F.col("shard"), F.lit(False).alias("copied")),
        F.when(previous.isNotNull(), F.struct(previous.alias("shard"), F.lit(True).alias("copied"))))))).select(
            "doc_id", "text", "to.shard", "to.copied")


def _bucket(value: Column, cuts: list[int]) -> Column:
    """Number of cut points below a value, by bisection; 0 for null."""
    points = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(cuts)) & (F.get(points, at + step - 1) < value), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def compare_with_edits(docs: DataFrame, fraction: float = FRACTION, shards: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document are.

    ``near_*`` are containments of the document in the other text, ``jaccard_*`` the symmetric likeness. The
    following document is the next in order of id, then text; null ids come first. Rows with one id stay in
    one shard, and every shard is a task. After the last row comes the first. ``support`` is what the estimates rest on.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = docs.select(F.min(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.coalesce("text", F.lit("")))).alias("x")).first()["x"]
    wrap = lowest[2] if lowest else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a shard end with the copies of the next shard's first rows; of these only the first is used.
        waiting, open_shard = None, None
        last = (None, wrap, sketches(pa.array([wrap]), fraction)[0])
        for piece in pieces(batches):
            ids, shard = piece.column(0).to_pylist(), piece.column(2).to_pylist()
            copied, texts = piece.column(3).to_pylist(), [t or "" for t in piece.column(1).to_pylist()]
            own = sketches(pa.array(texts, pa.string()), fraction)
            pairs = []
            for k in range(len(ids)):
                now = (ids[k], texts[k], own[k])
                if waiting and shard[k] == open_shard:
                    pairs.append((waiting, now))
                elif waiting:
                    pairs.append((waiting, last))
                waiting, open_shard = None if copied[k] else now, shard[k]
            if pairs:
                yield emit(pairs)
        if waiting:
            yield emit([(waiting, last)])

    def emit(pairs) -> pa.RecordBatch:
        changed = [edited(a[1], b[1]) for a, b in pairs]
        new = sketches(pa.array(changed, pa.string()), fraction)
        columns = [
            pa.array([a[0] for a, _ in pairs], pa.int64()),
            pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([encode(a[2]) for a, _ in pairs]),
            pa.array([encode(s) for s in new]),
            *(pa.array([f(a[2], other) for (a, _), other in zip(pairs, others)], pa.float64())
              for f in (containment, jaccard) for others in (new, [b[2] for _, b in pairs])),
            pa.array([support(a[2], fraction) for a, _ in pairs], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
            "jaccard_edited", "jaccard_next", "support"])

    placed = with_following(docs, n)
    return placed.repartitionById(n, "shard").sortWithinPartitions("shard", "copied", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, jaccard_edited double, jaccard_next double, support long")


@query("op2_document_fingerprints")
def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_edits(table(spark, folder, "documents"))
