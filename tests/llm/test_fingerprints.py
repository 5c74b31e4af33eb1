import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tastemill.llm import fingerprints as fp
from tastemill.llm import textbytes as tb

TEXTS = ["", None, "  \n", "one", "one two three four five", "One TWO three four five", "one two three four six",
         "a b c d e f g h i j k", "ü é ß x y z", "x" * 50_000, "w " * 3000, "tab\tand\nline five six seven"]


def plain_shingles(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_shingles_are_the_runs_of_five_words():
    hashes, bounds = tb.shingles(pa.array(TEXTS))
    known = {}
    for k, text in enumerate(TEXTS):
        own = hashes[bounds[k]:bounds[k + 1]]
        assert len(set(own)) == len(plain_shingles(text))
        for value, shingle in zip(own, [tuple(w) for w in _runs(text)]):
            assert known.setdefault(shingle, value) == value
    assert len(set(known.values())) == len(known)


def _runs(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return [words[i:i + 5] for i in range(max(1, len(words) - 4))] if words else []


def test_slices_and_pieces_do_not_change_hashes():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS * 3)], names=["text"])
    whole = [s.tolist() for s in fp.sketches(batch.column(0))]
    parts = [s.tolist() for p in tb.pieces([batch.slice(1)], limit=100) for s in fp.sketches(p.column(0))]
    assert parts == whole[1:]


def test_merge_encode_and_estimate():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(vocabulary, 20_000))
    part = " ".join(long.split()[3000:5000])
    a, b, both = fp.sketches(pa.array([part, long, part + " " + long]))
    assert abs(fp.containment(a, b) - 1) < 1e-9 and fp.containment(b, a) < 0.15
    merged = fp.merge(a, b)
    assert set(merged) <= set(both) and len(both) - len(merged) < 5
    assert fp.decode(fp.encode(a)).tolist() == a.tolist() and fp.encode(a[:0]) == ""


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        changed = fp.edited(text, following)
        a, b, c = fp.sketches(pa.array([text, changed, following]))
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.encode(a), fp.encode(b),
                    fp.containment(a, b), fp.containment(a, c)))
    return out


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_against_plain_order(spark, shards):
    rows = [(i * i, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(4, "again"), (4, "again"), (None, "lost")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, shard string, copied string")
    got = [tuple(r)[:7] for r in fp.compare_with_edits(df, shards=shards).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_empty_and_single(spark):
    schema = "doc_id long, text string"
    assert fp.compare_with_edits(spark.createDataFrame([], schema)).count() == 0
    row = fp.compare_with_edits(spark.createDataFrame([(3, "abcd")], schema)).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


@pytest.mark.parametrize("n_words", [5, 6, 10, 40, 200])
def test_short_texts_in_a_long_one(n_words):
    """Containment is 1 wherever the short text has support, and support fails as often as stated."""
    rng = np.random.default_rng(n_words)
    vocabulary = [f"w{i}" for i in range(5000)]
    long = list(rng.choice(vocabulary, 4000))
    parts = [" ".join(long[a:a + n_words]) for a in rng.integers(0, 4000 - n_words, 800)]
    whole, *own = fp.sketches(pa.array([" ".join(long), *parts]))
    known = np.array([fp.support(s) > 0 for s in own])
    assert all(fp.containment(s, whole) == (1.0 if k else 0.0) for s, k in zip(own, known))
    missing = (1 - fp.FRACTION) ** (n_words - 4)
    assert abs((~known).mean() - missing) < 4 * np.sqrt(missing * (1 - missing) / 800) + 0.04  # parts overlap


@pytest.mark.parametrize("share", [0.25, 0.5, 0.8])
def test_error_of_containment(share):
    rng = np.random.default_rng(int(share * 100))
    vocabulary = [f"w{i}" for i in range(5000)]
    errors = []
    for _ in range(60):
        own = list(rng.choice(vocabulary, 400))
        other = own[:int(400 * share)] + list(rng.choice(vocabulary, 3000))
        a, b = fp.sketches(pa.array([" ".join(own), " ".join(other)]))
        true = (int(400 * share) - 4) / 396
        errors.append((fp.containment(a, b) - true) / np.sqrt(true * (1 - true) / fp.support(a)))
    assert np.sqrt(np.mean(np.square(errors))) < 1.4 and np.max(np.abs(errors)) < 4.5


def test_every_shard_is_a_task(spark):
    df = spark.range(4000).selectExpr("id doc_id", "concat('text ', id) text")
    found = fp.compare_with_edits(df, shards=16).selectExpr("spark_partition_id() p").groupBy("p").count().collect()
    assert len(found) == 16 and max(r["count"] for r in found) < 500
