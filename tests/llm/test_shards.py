import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tastemill.llm import shards as sh

SCHEMA = "doc_id long, text string, lang string, source string, shard int, size string"


def brute(points, n_shards):
    """The same tree over sorted arrays."""
    ranges = {c: np.ptp([p[c] for p in points]) for c in sh.DIMENSIONS}
    out = {}

    def cut(own, first, k):
        if k == 1:
            for p in own:
                out[p["h1"], p["h2"], p["piece"]] = first
            return
        if not own:
            return
        spread = {c: np.ptp([p[c] for p in own]) / max(ranges[c], 1e-300) for c in sh.DIMENSIONS}
        c = max(sh.DIMENSIONS, key=lambda c: (spread[c], -sh.DIMENSIONS.index(c)))
        own = sorted(own, key=lambda p: (p[c], p["tie"]))
        weight = np.array([p["weight"] for p in own])
        goal = weight.sum() * (k // 2) / k
        at = int(np.searchsorted(np.cumsum(weight), goal - 1e-9 * weight.sum()))
        left = at + (goal - weight[:at].sum() > weight[at] / 2)
        cut(own[:left], first, k // 2)
        cut(own[left:], first + k // 2, k - k // 2)

    cut(points, 0, n_shards)
    return out


def corpus():
    rng = np.random.default_rng(6)
    rows = [(int(i), "é" * int(n), ["en", "de", None][i % 3], f"src{i % 5}", None, "a")
            for i, n in enumerate(rng.integers(0, 400, 900))]
    rows += [(10_000 + i, "copy of a text " * 6, "en", f"src{i % 7}", 1, None) for i in range(500)]
    rows += [(20_000 + i, "small group", "fr", f"src{i}", 1, None) for i in range(4)]
    return rows + [(None, None, None, None, None, None), (5, "", "", "", 2, "x"), (5, "", "", "", 2, "x"), (7, "long " * 900, "es", "src1", 0, "")]


@pytest.mark.parametrize("n_shards", [1, 5, 24])
def test_law_slots_and_groups(spark, n_shards):
    rows = corpus()
    got = sh.shard_documents(spark.createDataFrame(rows, SCHEMA), n_shards).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    total, target = defaultdict(int), sum(size(r[1]) for r in rows) / n_shards
    by_shard = defaultdict(list)
    for r in got:
        total[r.shard] += r.size
        by_shard[r.shard].append(r.slot)
    assert set(total) == set(range(n_shards)) and all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    if n_shards < 24:
        assert max(total.values()) < 1.1 * target and min(total.values()) > 0.9 * target
    assert len({r.shard for r in got if r.size == 8 + len("small group") and (r.doc_id or 0) >= 20_000}) == 1


def test_tree_against_sorted_arrays(spark, folder):
    df = spark.createDataFrame(corpus(), SCHEMA)
    rows = sh.base_rows(df)
    pts = sh.points(rows, sum(r.size for r in rows.collect()) / 11)
    pts.write.parquet(f"{folder}/points")
    pts = spark.read.parquet(f"{folder}/points")
    got = {(r.h1, r.h2, r.piece): r.shard for r in sh.grow_tree(spark, pts, 11, folder).collect()}
    assert got == brute([r.asDict() for r in pts.collect()], 11)


def test_empty_and_single(spark):
    df = spark.createDataFrame(corpus()[:1], SCHEMA)
    assert sh.shard_documents(df.limit(0)).count() == 0
    row = sh.shard_documents(df).first()
    assert row.slot == 0 and 0 <= row.shard < 24


def test_texts_rank_by_their_whole_length(spark):
    names = [None, "", "a", "common_", "common_books", "common_crawl_2019", "common_crawl_2020", "https://a.org", "https://b.org", "é"]
    df = spark.createDataFrame([(n, k) for k, n in enumerate(names)] * 3, "t string, k int")
    ranks = sorted((r.k, r.t) for r in sh.ranked(df, "t").collect())
    assert [t for _, t in ranks[::3]] == [-1.0, *map(float, range(9))]


def test_24_shards_are_near_equal(spark):
    rng = np.random.default_rng(11)
    rows = [(i, f"text {i} " * int(n), "en", f"common_crawl_{i % 9}", None, "a") for i, n in enumerate(rng.integers(1, 60, 6000))]
    total = Counter()
    for r in sh.shard_documents(spark.createDataFrame(rows, SCHEMA)).collect():
        total[r.shard] += r.size
    mean = sum(total.values()) / 24
    assert len(total) == 24 and max(total.values()) < 1.05 * mean and min(total.values()) > 0.95 * mean


def test_groups_that_fit_a_shard_stay_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"text {i} " * int(n), "en", f"src{i % 9}", None, "a") for i, n in enumerate(rng.integers(1, 60, 6000))]
    mean = sum(len(r[1]) + 8 for r in rows) / 6
    for g, share in enumerate((0.9, 0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1)):  # of what a shard holds at least
        text = f"group {g} " * 20
        rows += [(10_000 * (g + 1) + i, text, "de", f"src{i % 9}", None, "a") for i in range(int(share * mean / (len(text) + 8)))]
    rows += [(200_000 + i, f"{i} " + "a long text " * int(0.2 * mean / 12), None, None, None, None) for i in range(2)]
    got = sh.shard_documents(spark.createDataFrame(rows, SCHEMA), 8).collect()
    total, shards = Counter(), defaultdict(set)
    for r in got:
        total[r.shard] += r.size
        shards[r.text_crc32].add(r.shard)
    assert len(got) == len(rows) and all(len(x) == 1 for x in shards.values())
    mean = sum(total.values()) / 8
    assert len(total) == 8 and max(total.values()) < 1.02 * mean and min(total.values()) > 0.98 * mean


def test_settle():
    placed, room = sh.settle([(60.0, 9, 1, 1), (60.0, 9, 0, 2), (30.0, 9, 3, 3), (50.0, 9, 4, 4), (250.0, 1, 5, 5)], 3, 100.0)
    assert placed == [(5, 5, 0), (0, 2, 1), (1, 1, 2), (3, 3, 1)] and room == [0.0, 10.0, 40.0]  # 50 fits beside no other
    assert sh.settle([], 2, 7.0) == ([], [7.0, 7.0])


def test_one_text_larger_than_a_shard(spark):
    rows = [(0, "x" * 50_000, "en", "s", None, None)] + [(i, "y" * 90 + str(i), "en", "s", None, None) for i in range(1, 800)]
    total = Counter()
    for r in sh.shard_documents(spark.createDataFrame(rows, SCHEMA), 5).collect():
        total[r.shard] += r.size
    light = sorted(total.values())[:4]
    assert max(total.values()) == 50_008 and light[-1] < 1.02 * light[0]
