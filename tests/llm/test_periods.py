import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tastemill.llm import periods


def plain_runs(words):
    """All runs by trying every period at every place."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def found(numbers, bounds=None):
    got = periods.find_runs(np.asarray(numbers, np.int64), np.asarray(bounds or [0, len(numbers)]))
    return list(zip(*(x.tolist() for x in got)))


@settings(max_examples=600, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 4), st.integers(0, 160))
def test_same_as_trying_every_period(seed, letters, n):
    """Texts put together from repeated and re-used parts, with a few words changed."""
    rng, text = np.random.default_rng(seed), []
    while len(text) < n:
        if text and rng.random() < 0.5:
            at = rng.integers(0, len(text))
            part = text[at:at + rng.integers(1, 25)]
        else:
            part = rng.integers(0, letters, rng.integers(1, 12)).tolist()
        text += part * int(rng.integers(1, 5))
    for _ in range(rng.integers(0, 3)):
        if text:
            text[rng.integers(0, len(text))] = int(rng.integers(0, letters))
    text = text[:n]
    assert found(text) == plain_runs(text)


@pytest.mark.parametrize("q", [1, 2, 5, 6, 7, 8, 14, 15, 16, 30, 31, 32, 33, 62, 63, 64, 100])
def test_every_shift_of_shortest_runs(q):
    rng = np.random.default_rng(q)
    length = max(12, 2 * q)
    for shift in range(0, 40, 1 if q < 20 else 3):
        text = rng.permutation(10_000)[:shift + length + 9]
        text[shift:shift + length] = np.resize(text[shift:shift + q], length)
        assert found(text) == [(shift, length, q)]


def test_squares_of_periodic_parts():
    for p in range(1, 6):
        for size in range(4, 26):
            part = np.resize(np.arange(p), size).tolist()
            for around in ([], [p - 1], [7]):
                text = around + part + part + around
                assert found(text) == plain_runs(text)
                text = part + [9] + part + [9] + part[:-1] + around
                assert found(text) == plain_runs(text)


def test_fibonacci_words_have_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert found(b) == plain_runs(b)


def test_texts_side_by_side():
    rng = np.random.default_rng(3)
    texts = [np.resize(rng.integers(0, 3, rng.integers(1, 9)), rng.integers(0, 50)).tolist() for _ in range(40)] + [[1] * 30, [1] * 30, list(range(50))]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()
    want = [(b + s, length, q) for b, t in zip(bounds, texts) for s, length, q in plain_runs(t)]
    assert found(np.concatenate(texts), bounds) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60), st.data())
def test_successor(values, data):
    tree = periods.Successor(np.array(values, np.int64))
    low, high = sorted((data.draw(st.integers(0, len(values))), data.draw(st.integers(0, len(values)))))
    least = data.draw(st.integers(0, 80))
    want = min((v for v in values[low:high] if v >= least), default=-1)
    assert tree(np.array([low]), np.array([high]), np.array([least])).tolist() == [want]


def test_long_repetitive_texts_take_little_time():
    n = 60_000
    parts = [[1] * n, [1, 2] * (n // 2), ([1] * 500 + [2]) * (n // 501), ([1] * 500 + [2] + [1] * 400 + [3]) * (n // 902),
             list(range(1000)) * (n // 1000)]
    for text in parts:
        assert (0, len(text)) in {(s, length) for s, length, _ in found(text)}


def plain_row(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_query_same_as_trying_every_period(spark, folder):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["a", "B", "b", "é", "漢字"], rng.integers(0, 120)))) for i in range(199)]
    rows += [(200, None), (201, ""), (202, " \n\x0b\t "), (203, "x y  " * 20), (None, "la " * 40), (None, None), (204, "é" * 3000),
             (3, rows[3][1]), (3, rows[3][1]), (205, "one two\nthree\tfour " * 50)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, start int, runs string, n_words int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = periods.op13_periodic_runs(spark, folder)
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((plain_row(i, t) for i, t in rows), key=str)
    assert sum(r.n_runs for r in got.collect()) > 10
    assert periods.periodic_runs(docs.limit(0)).count() == 0
    kept = {r.doc_id: r.collapsed for r in periods.periodic_runs(docs).collect()}
    assert kept[205] == "one two three four" and kept[202] == "" and kept[204] == "é" * 3000


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(periods, "word_hashes", lambda data, starts, ends, letters: (ends - starts).astype(np.uint64))
    texts = ["ab cd ef gh " * 9, "x y " * 30, "x x " * 30]
    piece = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], names=["doc_id", "text"])
    got = [list(zip(*(x.tolist() for x in own))) for _, own, _ in periods._texts(piece, False)]
    assert got == [plain_runs(t.split()) for t in texts]
