import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tastemill.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return [zlib.crc32(g.encode()) % 10_000 for g in grams], len(words)


def plain(docs, target):
    """Rows of ``doc_id, n_features, weight, score, rank`` by dictionaries."""
    found = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in target for b in plain_features(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, f, n in found:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 .@[`{\x7f\x80é漢\n", max_size=60)), min_size=1, max_size=6))
def test_features(texts):
    bucket, text, n_words = resampling.features(pa.array([*texts, "x" * 200 + " " + "é" * 90], pa.string()))
    for k, value in enumerate(texts):
        want, n = plain_features(value)
        assert sorted(bucket[text == k]) == sorted(want) and n_words[k] == n
    assert sorted(bucket[text == len(texts)]) == sorted(plain_features("x" * 200 + " " + "é" * 90)[0])


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 600))
def test_planes_give_the_exact_sum(seed, n_texts):
    rng = np.random.default_rng(seed)
    gain = rng.integers(-9_000, 9_000, resampling.BUCKETS)
    text, bucket = rng.integers(0, n_texts, 3_000), rng.choice([3, 9_999, *rng.integers(0, 10_000, 50)], 3_000)
    want = np.bincount(text, gain[bucket], n_texts)
    assert (resampling.gain_sums(bucket, text, n_texts, resampling.gain_planes(gain)) == want).all()


def test_no_gain_or_feature():
    none = np.zeros(0, np.int64)
    assert (resampling.gain_sums(none, none, 3, resampling.gain_planes(np.zeros(resampling.BUCKETS, np.int64))) == 0).all()
    assert (resampling.gains(np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)) == 0).all()


def corpus():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(300)] + ["École", "straße", "A1"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 90)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " .,; "), (503, "the " * 30_000), (504, "one"), (None, "w1 w2 " * 30), (None, "w1 w2 " * 30)]
    docs += [(600, docs[3][1])] * 60 + [(3, docs[3][1]), (-4, "w5 " * 25)]  # a hot id, repeated ids
    return docs, ["w1 w2 w3 École w5", None, "", "A1 a1 w5 w5"]


def test_same_as_dictionaries(spark):
    docs, target = corpus()
    frame = spark.createDataFrame([(i, t, 9, "x", 1) for i, t in docs], "doc_id long, text string, rank int, bucket string, n int").repartition(5)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    got = resampling.resample(frame, wanted)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target)
    assert resampling.resample(frame.limit(0), wanted).count() == 0
    assert {r["rank"] for r in resampling.resample(frame, wanted, percent=0).collect()} == {None}
    no_target = resampling.resample(frame, wanted.limit(0))
    assert sorted((tuple(r) for r in no_target.collect()), key=str) == plain(docs, [])


def test_draws_what_is_like_the_target(spark):
    rng = np.random.default_rng(2)
    kinds = ["a b c d e f g".split(), "p q r s t u v".split()]
    docs = [(i, " ".join(rng.choice(kinds[i % 2], 40))) for i in range(200)]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame([(" ".join(kinds[1] * 5),)], "text string"))
    drawn = [r.doc_id for r in got.collect() if r["rank"]]
    assert len(drawn) == 50 and sum(i % 2 for i in drawn) >= 35
