import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tastemill.llm import chunk_table, packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)
WORDS = packing.WordIds(VOCABULARY)
TEXTS = ["", " ", "It's 12 a-b don't", "CAFÉ café ÀÉ!!", "x<|endoftext|>y <|startoftext|>", "漢字 İI ß ſ", "a b\x1cc d",
         "'s 's's", "word's, (word) word_", "́ e", "ΑΣ ς Σ", "don''t!", "a" * 3000, "ÀÖ×÷ß12,ø.. aÿ|<|x <|endoftext|>", "x\x1fy", "ªº µ", "A\tB\rC"]


def check(texts):
    ids, bounds = WORDS.encode(texts)
    for k, text in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_are_the_library_s():
    check(TEXTS)
    check(TEXTS[::-1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="aAéÉ '!.,s\n\t́<|1", max_size=20), st.text(max_size=12)), max_size=5))
def test_ids_of_any_text(texts):
    check(texts)


def test_full_table():
    small = packing.WordIds(VOCABULARY, max_words=4)
    for text in ("a b c d e f g", "h i j a", "k l m n o p a b", "q r s t u v a h") * 2:
        ids, _ = small.encode([text])
        assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert 4 <= len(small.words) < 26


def test_words_with_one_hash(monkeypatch):
    monkeypatch.setattr(chunk_table, "word_hashes", lambda data, starts, ends, letters: (ends - starts).astype(np.uint64))
    words = packing.WordIds(VOCABULARY)
    for texts in (["ab cd ef ab", "", "cd é x y é"], ["ef gh ab cd", "y x"], TEXTS):
        ids, bounds = words.encode(texts)
        for k, text in enumerate(texts):
            assert ids[bounds[k]:bounds[k + 1]].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def best_fill(counts, capacity):
    """All sums that hold the longest piece, by trying every piece."""
    items = [k for k, n in enumerate(counts) for _ in range(n)]
    longest = items.pop()
    sums = {longest}
    for item in items:
        sums |= {s + item for s in sums if s + item <= capacity}
    return max(sums)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=14))
def test_fill_is_the_best(lengths):
    counts = np.bincount(lengths, minlength=41)
    taken = packing.fill(counts, 40)
    assert all(0 < n <= counts[k] for k, n in taken.items())
    assert sum(k * n for k, n in taken.items()) == best_fill(counts, 40)


def test_plan_uses_each_piece_once_and_is_short():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.minimum(rng.geometric(0.003, 3_000_000), 2048), minlength=2049)
    counts[700] += 1_000_000
    rows, left, windows = packing.plan(counts)
    assert len(rows) < 20_000
    used = np.zeros(2049, np.int64)
    for length, first, end, *_ in rows:
        assert first == used[length]
        used[length] = end
    line = 0
    for length, first, start in sorted(left, key=lambda x: x[2]):
        assert first == used[length] and start == line
        line += length * (counts[length] - first)
        used[length] = counts[length]
    assert (used == counts).all()
    assert (counts * np.arange(2049)).sum() / (windows * 2048 + line) > 0.9999


def padding(size):
    return 0 if size & (size - 1) == 0 else 2048 - size


def checked(df, rows):
    want = {}
    for i, text, *_ in rows:
        ids = np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.setdefault(i, []).append(ids)
    got = df.collect()
    filled = {}
    for r in got:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start:r.start + r.length]) == r.ids_crc32 for ids in want[r.doc_id])
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(ids) for own in want.values() for ids in own)
    assert sorted(filled) == list(range(len(filled)))
    waste = 0
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        waste += padding(at)
    return waste


def test_table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["word"] * int(n)), 1, "x") for i, n in enumerate(rng.integers(0, 700, 300))]
    rows += [(1000 + i, "copy " * 500, 2, None) for i in range(200)]
    rows += [(2000, None, 1, None), (2001, "", None, None), (2002, "long " * 9000, None, None), (2003, "word " * 2047, 0, ""),
             (2004, "same", 0, ""), (2004, "same", 0, ""), (None, "none", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, start string")
    tokens = sum(len(TOKENIZER.encode(t or "").ids) for _, t, *_ in rows)
    assert checked(packing.pack(df, VOCABULARY), rows) < 2048 + tokens // 500
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, "a b c") for i in range(n)], "doc_id long, text string")
    assert checked(packing.pack(df, VOCABULARY), [(i, "a b c") for i in range(n)]) == [0, 0][n - 1]
