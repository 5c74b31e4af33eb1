import numpy as np
import pyarrow as pa
import pytest

from tastemill.llm import jaccard as jj
from tastemill.llm.components import components


def graph_roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 50), (52, 51)],
    [(int(a), int(b)) for a, b in np.random.default_rng(2).integers(0, 300, (200, 2))]])
def test_components(spark, edges):
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in graph_roots(edges).items() if x != r}


def shingled(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(one, other):
    a, b = shingled(one), shingled(other)
    return bool(a) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def brute(rows):
    """Classes and links by comparing all pairs of whole sets."""
    own = [shingled(r[1]) for r in rows]
    linked = [[b for b in range(len(rows)) if b != a and own[a] and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]) - 1e-9]
              for a in range(len(rows))]
    root = graph_roots([(a, a) for a in range(len(rows))] + [(a, b) for a, bs in enumerate(linked) for b in bs])
    least = {}
    for k, r in enumerate(rows):
        least.setdefault(root[k], []).append(r[0])
    first = {k: min((x for x in ids if x is not None), default=None) for k, ids in least.items()}
    return sorted(((r[0], first[root[k]], len(linked[k])) for k, r in enumerate(rows)), key=str)


def corpus(seed=4):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(900)]
    text = lambda n: list(rng.choice(words, n))
    rows, passage = [], text(60)
    for n in (1, 2, 4, 5, 6, 9, 30, 80, 300):
        base = text(n)
        for edits in (0, 0, 1, 2, 4, 9):
            copy = list(base)
            for at in rng.integers(0, n, edits):
                copy[at] = "changed"
            rows.append(" ".join(copy))
    chain = text(120)
    for k in range(12):  # each is near the next, the ends are far apart
        chain = [*chain[4:], *text(4)]
        rows.append(" ".join(chain))
    hot = text(100)
    for k in range(90):  # one large group of near copies
        copy = list(hot)
        copy[int(rng.integers(0, 100))] = f"own{k}"
        rows.append(" ".join(copy))
    rows += [" ".join(text(40) + passage + text(40)) for _ in range(20)]  # share a passage, are not alike
    rows += [" ".join(hot)] * 15 + [None, None, "", " \n "]
    rows += ["W1 w2 W3 w4 w5 w6", "w1 w2  w3\tw4 w5 w6"]
    out = [(int(i), t, "x", 1, "y") for i, t in zip(rng.permutation(len(rows)), rows)]
    return [*out, (out[70][0], out[70][1], "again", 2, None), (None, "null id one two three four", None, None, None),
            (None, "null id one two three four", None, None, None), (out[0][0], "same id, other text, five words", "z", 0, "")]


SCHEMA = "doc_id long, text string, sig string, n int, root string"


@pytest.mark.parametrize("bucket_tile, group_tile", [(jj.BUCKET_TILE, jj.GROUP_TILE), (16, 20)])
def test_against_all_pairs(spark, bucket_tile, group_tile):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = jj.similarity_classes(df, bucket_tile=bucket_tile, group_tile=group_tile).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert jj.similarity_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert jj.one_of_each_class(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_each_class(spark):
    """Ids repeat with other texts, in other classes and in the same one; rows repeat as a whole."""
    rng = np.random.default_rng(9)
    a, b, c, d = (" ".join(rng.choice([f"w{i}" for i in range(500)], 40)) for _ in range(4))
    rows = [(5, a), (5, b), (3, b + " more"), (9, c), (9, c + " tail"), (7, d), (7, d), (7, d), (2, d + " x y"), (11, ""), (11, ""), (12, None),
            (None, a + " z"), (None, "a null id of its own with words"), (None, "a null id of its own with words")]
    rows += [(int(i), t) for i, t, *_ in corpus(6)[:150]]
    rows = [(i, t, "x", k % 2, "y") for k, (i, t) in enumerate(rows)]
    got = jj.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string, text_hash string, n int, whole string"))
    assert got.columns == ["doc_id", "text", "text_hash", "n", "whole"]
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= {r[:2] for r in rows}
    linked = [(k, j) for k, x in enumerate(rows) for j, y in enumerate(rows) if j <= k and similar(x[1], y[1])]
    classes = {}
    for k, root in graph_roots([*linked, *((k, k) for k in range(len(rows)))]).items():
        classes.setdefault(root, set()).add(rows[k][:2])
    for members in classes.values():
        if not any((t or "").split() for _, t in members):
            assert members <= set(kept)
            continue
        least = min((i is None, i) for i, _ in members)[1]
        stays = [row for row in kept if row in members]
        assert len(stays) == 1 and stays[0][0] == least


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 4000, np.uint64)
    for keep in (0.5, 0.8, 0.95):
        b = np.concatenate([a[:int(keep * 4000)], rng.integers(0, 1 << 63, int((1 - keep) * 4000), np.uint64)])
        true = keep / (2 - keep)
        assert abs((jj.minhashes(a) == jj.minhashes(b)).mean() - true) < 4 * np.sqrt(true * (1 - true) / jj.VALUES)


def test_pruning_keeps_pairs_at_the_threshold():
    need = jj.needed_matches(0.8, 1e-8)
    assert need == tuple(sorted(need)) and need[-1] < 0.7 * jj.VALUES and need[-1] > 0.4 * jj.VALUES
    rng = np.random.default_rng(1)
    left = rng.integers(0, 256, (1, jj.VALUES)).astype(np.uint8)
    near = np.where(rng.random((2000, jj.VALUES)) < 0.8, left, rng.integers(0, 256, (2000, jj.VALUES))).astype(np.uint8)
    far = np.where(rng.random((2000, jj.VALUES)) < 0.3, left, rng.integers(0, 256, (2000, jj.VALUES))).astype(np.uint8)
    assert jj.plausible(left, near, need).all() and jj.plausible(left, far, need).mean() < 0.01


def test_forest_keeps_groups_together():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (5, jj.VALUES)).astype(np.uint8)
    group = rng.integers(0, 5, 200)
    sig = np.where(rng.random((200, jj.VALUES)) < 0.95, base[group], rng.integers(0, 256, (200, jj.VALUES))).astype(np.uint8)
    a, b = jj.forest(sig, jj.needed_matches(0.8, 1e-8))
    assert len(a) == 195 and (group[a] == group[b]).all()
    root = graph_roots(zip(a.tolist(), b.tolist()))
    assert len({root[k] for k in range(200)}) == 5


def test_intersections():
    rng = np.random.default_rng(5)
    own = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 3000, 6000, 6000)]
    want = [[len(set(a) & set(b)) for b in own] for a in own]
    assert jj.intersections(own).tolist() == want
    assert isinstance(jj.sets(pa.array(["a b c d e f"]))[0], np.ndarray)
