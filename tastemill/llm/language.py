"""Language of texts by error-correcting output codes over character n-grams.

Every language has a codeword of bits. For each bit a logistic classifier over hashed letter bigrams and
trigrams says which side a text is on; decoding adds up the classifiers' losses against each codeword, a
reliable classifier weighing more, and takes the language with the least. With few languages every split of
them into two sides is a bit, with many a fixed number of well separated random ones, so that the wrong
answers of some classifiers are outvoted.

Fitting takes a bounded sample: at most ``SAMPLE_ROWS`` labelled documents, the same number of every language
as far as it has them, those with the smallest hashes of id and text, so the sample is the same however the table
is partitioned. Each goes in whole and as two short snippets. Their features are made in the tasks; what reaches the
driver is at most three sparse vectors of ``FEATURES`` numbers a document, however long the texts. At most
``LANGUAGES`` languages are learned, those with most documents. Prediction reads whole texts of all documents in
one pass.

Null or letterless texts get ``und`` with score 0. Nothing to learn from gives ``und`` for all; a single
learned language is given to every text with letters, with score 1. Equal texts get equal answers; ties go
to the language first in the alphabet. A table may have any other columns. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastemill.llm.registry import query, table
from tastemill.llm.textbytes import pieces

UNDETERMINED = "und"
FEATURES = 4096
SAMPLE_ROWS = 3000
LANGUAGES = 200
AMBIGUOUS_GAP = 0.1
SNIPPET = 48
ROWS = 128  # texts whose features are made at a time, and about so many bytes of them
BYTES = 1 << 19


@cache
def _letters() -> np.ndarray:
    """For every code point the lower case letter, or 0 if it is no letter."""
    found = np.zeros(0x110000, np.uint32)
    for code in range(len(found)):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            found[code] = ord(low) if len(low) == 1 else code
    return found


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of square roots of n-gram counts, one row for each text, and the number of letters.

    Words are runs of letters with a blank at both ends; n-grams do not cross from one text to the next.
    """
    n = len(texts)
    lengths = np.fromiter((len(t) + 2 if t else 2 for t in texts), np.int64, n)
    joined = "".join(f" {t} " if t else "  " for t in texts)
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(n, dtype=np.int64), lengths)
    letter = codes > 0
    n_letters = np.bincount(row[letter], minlength=n)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])  # of several blanks the first
    codes, row = codes[keep], row[keep]
    counts = np.zeros(n * FEATURES, np.float32)
    mixed = codes * np.uint32(0x9E3779B1)
    two = mixed[:-1] + (mixed[1:] ^ (mixed[1:] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    three = two[:-1] + (mixed[2:] ^ (mixed[2:] >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    for gram, size in ((two, 2), (three, 3)):
        gram = gram ^ (gram >> np.uint32(16))
        at = row[:len(gram)] * FEATURES + (gram * np.uint32(0x27D4EB2F) >> np.uint32(20)).astype(np.int64)
        # inside one text, with a letter first or second
        inside = (row[:len(gram)] == row[size - 1:]) & ((codes[:len(gram)] > 0) | (codes[1:len(gram) + 1] > 0))
        counts += np.bincount(at[inside], minlength=len(counts)).astype(np.float32)
    x = np.sqrt(counts.reshape(n, FEATURES))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x, n_letters


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each of ``n`` languages; no two columns make the same split."""
    if n <= 7:
        others = range(1, n)
        columns = [[1] + [1 if k in side else -1 for k in others]
                   for size in range(n - 1) for side in combinations(others, size)]
        return np.array(columns, np.float64).reshape(-1, n).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = [np.sign(rng.random((n, width)) - 0.5) for _ in range(50)]
    return max(tries, key=lambda m: -(m @ m.T - 2 * width * np.eye(n)).max())


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # features + 1 x bits
    trust: np.ndarray  # bits

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability and its lead over the next."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = np.stack([np.logaddexp(0, -margin * code) @ self.trust for code in self.codes], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = -1
        return best, top, top - np.maximum(p.max(axis=1), 0)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """One classifier for each bit by gradient steps, all bits at once; bits are trusted by how well they fit.

    ``x`` has a row of features and ``langs`` a language for each text."""
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    target = codes[np.searchsorted(languages, langs)]
    w, b = np.zeros((FEATURES, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    speed_w, speed_b, rate = np.zeros_like(w), np.zeros_like(b), 8.0
    for _ in range(150):  # rows are unit vectors, so this step is within the curvature bound
        pull = target / (1 + np.exp(target * (x @ w + b)))
        speed_w = 0.9 * speed_w + (x.T @ pull.astype(np.float32)) / len(x) - 1e-5 * w
        speed_b = 0.9 * speed_b + pull.mean(axis=0)
        w, b = w + rate * 0.5 * speed_w, b + 0.5 * speed_b
    right = (np.sign(x @ w + b) == target).mean(axis=0)
    trust = np.maximum(2 * right - 1, 0.01)
    return Model(languages, codes, np.concatenate([w, b[None]]).astype(np.float64), trust / trust.mean() if len(trust) else trust)


def held_out(key: str = "doc_id") -> Column:
    """Documents kept out of fitting: crc32 of the id as text leaves 1 when divided by 3; a missing id does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(0)) % 3 == 1


def hash_bound(each: int, n: int) -> int:
    """The 64-bit hash below which about ``2 * each`` of ``n`` rows lie, with room so that ``each`` of them nearly always do."""
    wanted = 2 * each + 40
    return (1 << 63) - 1 if wanted >= n else (wanted << 64) // n - (1 << 63)


def training_rows(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = LANGUAGES) -> DataFrame:
    """``lang`` and the sparse features of a whole text and of two snippets of it, for each document of the sample."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    each = max(1, sample_rows // max(1, len(counts)))
    bound = F.lit(None).cast("bigint")
    if counts:
        bound = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], hash_bound(each, r["n"]))])[F.col("lang")]
    drawn = usable.withColumn("h", F.xxhash64(F.lit(11), "doc_id", "text")).where(F.col("h") <= bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=BYTES):
            texts, out = batch.column(1).to_pylist(), []
            for k in range(0, len(texts), ROWS):
                part = texts[k:k + ROWS]
                views = [part, *([t[len(t) * n // 3:][:SNIPPET] for t in part] for n in (1, 2))]
                made = [features(view)[0] for view in views]
                for i in range(len(part)):
                    at = [np.flatnonzero(x[i]) for x in made]
                    out.append([a.astype("<u2").tobytes() for a in at] + [x[i][a].astype("<f4").tobytes() for x, a in zip(made, at)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), *(pa.array(c, pa.binary()) for c in zip(*out))],
                names=["doc_id", "lang", "h", *(f"at{k}" for k in range(3)), *(f"x{k}" for k in range(3))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = drawn.mapInArrow(run, f"doc_id {kind}, lang string, h long, at0 binary, at1 binary, at2 binary, x0 binary, x1 binary, x2 binary")
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "at0", "x0")
    return made.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = LANGUAGES) -> Model | None:
    """Fit on the sample; None if no document can be learned from."""
    rows = training_rows(docs, sample_rows, most).orderBy("lang", "place").collect()  # at most sample_rows, or one a language
    if not rows:
        return None
    x = np.zeros((3 * len(rows), FEATURES), np.float32)
    for k, row in enumerate(rows):
        for n in range(3):
            x[3 * k + n, np.frombuffer(row[f"at{n}"], "<u2")] = np.frombuffer(row[f"x{n}"], "<f4")
    return fit(x, [row["lang"] for row in rows for _ in range(3)])


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",),
             gap: float = AMBIGUOUS_GAP) -> DataFrame:
    """``keep`` (none of these names), then ``lang_pred``, ``score`` and ``ambiguous`` (the next language is within ``gap``)."""
    fields = {f.name: f for f in docs.schema}
    kinds = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", BYTES):
            texts = batch.column(len(keep)).to_pylist()
            names, scores, unsure = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if model:
                for k in range(0, len(texts), ROWS):
                    x, n_letters = features(texts[k:k + ROWS])
                    best, top, lead = model.decode(x)
                    for i in np.flatnonzero(n_letters):
                        names[k + i], scores[k + i] = model.languages[best[i]], top[i]
                        unsure[k + i] = lead[i] < gap
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(names), pa.array(scores), pa.array(unsure)],
                names=[*keep, "lang_pred", "score", "ambiguous"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(
        run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model | None, gap: float = AMBIGUOUS_GAP) -> DataFrame:
    """The rows, with all their columns, whose texts have letters and one language that leads the next by ``gap``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and model:
                named = pa.RecordBatch.from_arrays(batch.columns, names=[*(f"c{k}" for k in range(at)), "text", *(
                    f"c{k}" for k in range(at + 1, batch.num_columns))])
                for piece in pieces([named], limit=BYTES):
                    texts, keep = piece.column(at).to_pylist(), []
                    for k in range(0, len(texts), ROWS):
                        x, n_letters = features(texts[k:k + ROWS])
                        keep.append((n_letters > 0) & (model.decode(x)[2] >= gap))
                    yield pa.RecordBatch.from_arrays(piece.columns, schema=batch.schema).filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify(docs, learn(docs))
    return found.withColumn("held_out", held_out())
