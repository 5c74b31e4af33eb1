"""Training, ranking, factor scores, numbering."""

import random
import re
import time
import tracemalloc
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastemill import schemas
from tastemill.config import AlsConfig
from tastemill.operators import als, factors
from tastemill.operators.factors import _norm, score_topn, similar_by_factors
from tastemill.operators.numbering import dense_index
from tastemill.operators.ranking import rank_recommendations
from tastemill.operators.upsert import RECOMMENDATION_KEY
from tastemill.plans import model_queries
from tastemill.plans.batch_als import recommend, run_batch_als
from tastemill.session import release
from tastemill.sources import warehouse
from tastemill.sources.store import KeyedTable

TINY = AlsConfig(rank=3, reg_param=0.1, max_iter=3, top_n=4, max_user_id=None)


def ratings(spark, shift=0):
    rng = random.Random(1)
    rows = [(u + shift, m + shift, float(rng.randint(1, 5))) for u in range(12) for m in range(10) if rng.random() < 0.6]
    return spark.createDataFrame(rows, "userId bigint, movieId bigint, rating double")


def test_same_seed_same_ranks(spark):
    runs = [sorted((r["userId"], r["rank"], r["movieId"]) for r in recommend(ratings(spark), TINY).collect())
            for _ in range(2)]
    assert runs[0] == runs[1]
    by_user = {}
    for user, rank, _ in runs[0]:
        by_user.setdefault(user, []).append(rank)
    assert all(ranks == [1, 2, 3, 4] for ranks in by_user.values())


def test_ids_beyond_int(spark):
    small, big = ratings(spark), ratings(spark, shift=2**31)
    expected = {(r["userId"] + 2**31, r["rank"], r["movieId"] + 2**31) for r in recommend(small, TINY).collect()}
    assert {(r["userId"], r["rank"], r["movieId"]) for r in recommend(big, TINY).collect()} == expected


def test_no_ratings(spark):
    with pytest.raises(ValueError):
        recommend(ratings(spark).limit(0), TINY)


def test_sample_bound(spark):
    users = {r["userId"] for r in recommend(ratings(spark), AlsConfig(3, 0.1, 2, 4, max_user_id=5)).collect()}
    assert users and max(users) <= 5


def test_published_once(spark, folder):
    target = KeyedTable(spark, folder, schemas.RECOMMENDATION, RECOMMENDATION_KEY, 2)
    first = run_batch_als(ratings(spark), target, 0, TINY).collect()
    again = run_batch_als(ratings(spark).limit(0), target, 0, TINY).collect()
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, again), key=repr)
    other = AlsConfig(rank=3, reg_param=0.1, max_iter=3, top_n=2, max_user_id=None)
    replaced = run_batch_als(ratings(spark), target, 1, other)
    assert replaced.agg(F.max("rank")).first()[0] == 2


def test_subset_of_users(spark):
    model = als.train_als(als.training_frame(ratings(spark), 4), TINY)
    some = spark.createDataFrame([(3,), (4,)], "user int")
    assert {r["userId"] for r in als.recommend_all(model, 2, some).collect()} == {3, 4}
    assert als.recommend_all(model, 2).count() == 24


def test_ranking_ties(spark):
    scored = spark.createDataFrame([(1, 9, 1.0), (1, 3, 1.0), (1, 5, 2.0)], "userId bigint, movieId bigint, score double")
    ranked = rank_recommendations(scored, 2).orderBy("rank").collect()
    assert [(r["movieId"], r["rank"], r["algorithm"]) for r in ranked] == [(5, 1, "ALS"), (3, 2, "ALS")]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id bigint, features array<float>")


def brute(users, items, n):
    found = []
    for user, left in users:
        scores = [(-float(np.dot(np.float64(np.float32(left)), np.float64(np.float32(right)))), item)
                  for item, right in items]
        # Scores that differ by rounding alone count as equal.
        scores = sorted((round(score, 9), item) for score, item in scores)[:n]
        found += [(user, item, rank) for rank, (_, item) in enumerate(scores, 1)]
    return sorted(found)


def test_top_items_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    # Lengths differ a lot, a third of the items are copies of one, one item and one user are zero.
    items = [(i, (rng.normal(size=6) * 2.0 ** -(i % 7)).tolist()) for i in range(60)]
    items += [(100 + i, items[5][1]) for i in range(30)] + [(200, [0.0] * 6)]
    users = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(99, [0.0] * 6)]
    expected = brute(users, items, 5)
    for blocks in ((7, 8), (1024, 4096)):
        found = score_topn(vectors(spark, users), vectors(spark, items), 5, *blocks)
        assert sorted((r["userId"], r["movieId"], r["rank"]) for r in found.collect()) == expected


def test_top_unseen_items_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    items = [(i, (rng.normal(size=4) * 2.0 ** -(i % 5)).tolist()) for i in range(80)] + [(200, [0.0] * 4)]
    users = [(i, rng.normal(size=4).tolist()) for i in range(25)] + [(99, [0.0] * 4)]
    seen = {(u, int(m)) for u in range(20) for m in rng.choice(80, rng.integers(0, 70), replace=False)}
    seen |= {(20, m) for m, _ in items} | {(21, m) for m, _ in items[3:]} | {(22, 10 ** 12), (10 ** 12, 3)}
    # The best of one user are all seen, so the first blocks do not do.
    best = sorted(items, key=lambda item: -float(np.dot(users[23][1], item[1])))
    seen |= {(23, m) for m, _ in best[:40]}
    expected = [row for user in users for row in brute([user], [item for item in items if (user[0], item[0]) not in seen], 5)]
    pairs = spark.createDataFrame([*seen, *list(seen)[:50]], "userId bigint, movieId bigint")
    for blocks in ((7, 8), (1024, 4096)):
        found = score_topn(vectors(spark, users), vectors(spark, items), 5, *blocks, exclude=pairs)
        assert sorted((r["userId"], r["movieId"], r["rank"]) for r in found.collect()) == sorted(expected)


def test_cones_prune_unit_vectors(spark, monkeypatch):
    """Directions in clusters, all of length 1: a user asks for few of the blocks and the lists are the same."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 8))

    def units(count):
        found = centres[rng.integers(0, 20, count)] + 0.05 * rng.normal(size=(count, 8))
        return (found / np.linalg.norm(found, axis=1, keepdims=True)).tolist()

    items, users = list(enumerate(units(1000))), list(enumerate(units(60)))
    asked, score = [], factors._score

    def counted(wanted, *rest):
        asked.append(wanted.count())
        return score(wanted, *rest)

    monkeypatch.setattr(factors, "_score", counted)
    found = score_topn(vectors(spark, users), vectors(spark, items), 5, 16, 50)
    assert sorted((r["userId"], r["movieId"], r["rank"]) for r in found.collect()) == brute(users, items, 5)
    blocks = len(factors._dealt(vectors(spark, items), 50)[1].block)
    assert blocks >= 20 and sum(asked) <= 60 * blocks / 3


def test_recommendations_without_seen_items(spark):
    given = ratings(spark)
    seen = {(r["userId"], r["movieId"]) for r in given.collect()}
    found = recommend(given, AlsConfig(rank=3, reg_param=0.1, max_iter=3, top_n=4, exclude_seen=True)).collect()
    assert not seen & {(r["userId"], r["movieId"]) for r in found}
    for user in range(12):
        unseen = 10 - sum(u == user for u, _ in seen)
        assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"]) if r["userId"] == user] == list(range(1, min(4, unseen) + 1))


def test_fewer_items_than_asked(spark):
    items, users = [(1, [1.0, 0.0]), (2, [0.0, 2.0])], [(7, [1.0, 1.0])]
    found = score_topn(vectors(spark, users), vectors(spark, items), 5)
    assert [(r["movieId"], r["score"]) for r in found.orderBy("rank").collect()] == [(2, 2.0), (1, 1.0)]


def test_similar_by_factors(spark):
    items = vectors(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])])
    found = {(r["id"], r["rank"]): r["similarId"] for r in similar_by_factors(items, 1).collect()}
    assert found == {(1, 1): 2, (2, 1): 1, (3, 1): 2}


def test_dense_numbers(spark):
    keys = spark.range(1000).select((F.col("id") * 7 - 50).alias("key")).repartition(7)
    rows = sorted((r["n"], r["key"]) for r in dense_index(keys, "key", "n").collect())
    assert rows == [(i, i * 7 - 50) for i in range(1000)]
    assert dense_index(keys.limit(0), "key", "n").count() == 0


def test_the_better_model_is_kept(spark, folder):
    frame = als.training_frame(ratings(spark))
    model, cfg, errors = als.choose_model(frame, frame, [AlsConfig(rank=3, reg_param=r, max_iter=3) for r in (5.0, 0.05)])
    assert cfg.reg_param == 0.05 and errors[1] < errors[0]
    als.save_model(model, folder, "one")
    lists = [sorted(map(tuple, als.recommend_all(m, 3).collect())) for m in (model, als.load_model(folder, "one"))]
    assert lists[0] == lists[1]
    with pytest.raises(Exception, match="already exists"):
        als.save_model(model, folder, "one")


def test_rmse(spark):
    assert als.rmse(als.training_frame(ratings(spark)), TINY).first()[0] > 0


def test_lengths_are_exact_to_double_precision(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(50)]
    found = {r["id"]: r["norm"] for r in vectors(spark, rows).select("id", _norm("features").alias("norm")).collect()}
    for key, vector in rows:
        assert abs(found[key] / np.linalg.norm(np.float64(np.float32(vector))) - 1) < 1e-14


def test_items_are_copied_once_a_group(spark):
    """No row per user and block is shuffled, however little the blocks exclude."""
    rng = np.random.default_rng(11)
    users, items = ([(i, row) for i, row in enumerate(rng.normal(size=(size, 6)).tolist())] for size in (300, 400))
    found = score_topn(vectors(spark, users), vectors(spark, items), 5, 100, 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(blocks" not in plan and "FlatMapCoGroupsInPandas" not in plan
    assert sorted((r["userId"], r["movieId"], r["rank"]) for r in found.collect()) == brute(users, items, 5)


def test_blocks_out_of_reach_are_not_multiplied():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 8))
    items, users = (factors._directions(np.repeat(centres, size, axis=0) + 0.05 * rng.normal(size=(20 * size, 8))) for size in (50, 3))
    pivots = factors._directions(centres)
    blocks = [slice(at, at + 50) for at in range(0, 1000, 50)]
    cones = factors.Cones(pivots, pd.DataFrame(
        [(k << 32, 1.0, (items[own] @ pivots[k]).min()) for k, own in enumerate(blocks)], columns=["block", "longest", "widest"]))
    nothing = np.zeros(0, np.int64)
    lists = factors.Lists(np.arange(60), users, (nothing, nothing), 5)
    lists.start(np.arange(1000), items)
    for k, own in enumerate(blocks):
        lists.offer(np.arange(own.start, own.stop), items[own], cones.bounds(k << 32, lists.vectors, lists.length))
    found = [tuple(row) for batch in lists.batches() for row in zip(*(batch.column(c).to_pylist() for c in ("userId", "movieId", "rank")))]
    exact = users @ items.T
    assert found == [(u, int(m), k) for u in range(60) for k, m in enumerate(np.argsort(-exact[u], kind="stable")[:5], 1)]
    assert lists.pairs <= 60 * 1000 / 3


def test_lists_of_repeated_users_equal_items_and_odd_vectors(spark, monkeypatch):
    """Rows of one user share a list, ties go to the lower id whatever the block, items that are no numbers take no part."""
    monkeypatch.setattr(factors, "WAITING", 3)
    items = [(i, [1.0, 0.0]) for i in range(40)] + [(50, [float("nan"), 1.0]), (51, [0.0, 2.0]), (51, [0.0, 2.0])]
    users = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])]
    found = score_topn(vectors(spark, users), vectors(spark, items), 3, 2, 7)
    assert sorted((r["userId"], r["rank"], r["movieId"]) for r in found.collect()) == [
        (1, 1, 51), (1, 2, 51), (1, 3, 0), (2, 1, 0), (2, 2, 1), (2, 3, 2), (3, 1, 0), (3, 2, 1), (3, 3, 2)]


def test_training_blocks_do_not_grow_before_memory_asks(spark, monkeypatch):
    """A factor is sent to every block that needs it, so 36 million ratings are no reason for more than the least number."""
    asked = {}

    class Counted:
        sparkSession = spark

        def count(self):
            return 36_000_000

    class Stopped:
        def __init__(self, **settings):
            asked.update(settings)

        def fit(self, frame):
            return None

    monkeypatch.setattr(als, "ALS", Stopped)
    als.train_als(Counted())
    assert asked["numUserBlocks"] == asked["numItemBlocks"] == 10


def shuffles(spark):
    """Numbers of the shuffles that have files."""
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(",")
    return set(re.findall(r"shuffle_(\d+)_", blocks))


def left_of(spark, before, most):
    """Shuffles that are still there since; files go a little later than the plans that made them."""
    for _ in range(20):
        if len(shuffles(spark) - before) <= most:
            break
        time.sleep(0.2)
    return len(shuffles(spark) - before)


def test_iterations_leave_no_shuffles(spark):
    """However many iterations there are, only the shuffles of the last one stay with the model."""
    frame = als.training_frame(ratings(spark)).persist()
    frame.count()
    kept = []
    for n in (2, 10):
        release(spark)
        before = shuffles(spark)
        model = als.train_als(frame, replace(TINY, max_iter=n))
        kept.append(left_of(spark, before, kept[0] if kept else 0))
        assert model.userFactors.count() == 12
    assert kept[1] <= kept[0]
    frame.unpersist()


def test_lists_do_not_hold_the_training(spark):
    """Before the lists are made, the shuffles of the ratings, the numbering and the training are gone."""
    release(spark)
    before = shuffles(spark)
    lists = recommend(ratings(spark).repartition(3), TINY)
    release(spark)
    assert left_of(spark, before, 4) <= 4
    assert "userFactors" not in lists._jdf.queryExecution().optimizedPlan().toString()
    assert lists.count() == 48


@pytest.mark.parametrize("query", [model_queries.als_time_split, model_queries.batch_als, model_queries.als_unseen_shape])
def test_ratings_are_read_once(spark, monkeypatch, query):
    """Neither another setting nor a second run makes the ratings anew."""
    made = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    given = ratings(spark).select("userId", "movieId", F.col("rating").cast("decimal(2,1)").alias("rating"),
                                  F.when((F.col("userId") + F.col("movieId")) % 4 > 0, 900_000_000).otherwise(1_000_000_000).cast("bigint").alias("timestamp"))
    n = given.count()
    monkeypatch.setattr(warehouse, "rating", lambda spark, folder: given.mapInArrow(told, given.schema))
    assert query(spark, "").count() > 0
    assert made.value == n


def test_blocks_go_to_groups_that_ask(spark):
    """Lengths differ: nearly all blocks are too short for every list, and no group gets them; asked are all that hold a list's items."""
    rng = np.random.default_rng(13)
    items = 1 + 0.2 * np.abs(rng.normal(size=(3000, 4)))
    items *= np.linspace(1, 3, 3000)[:, None]
    users = 1 + 0.2 * np.abs(rng.normal(size=(90, 4)))
    dealt, cones, sample = factors._dealt(vectors(spark, list(enumerate(items.tolist()))), 50)
    block = {row["id"]: row["block"] for row in dealt.collect()}
    for seen in (0, 30):
        given = pa.record_batch({"group": pa.array(np.arange(90, dtype=np.int32) % 3), "features": pa.array(users.tolist()),
                                 "seen": pa.array(np.full(90, seen))})
        found, = factors._asked_of(5, cones, sample, 3)(iter([given]))
        asked = set(zip(found.column("group").to_pylist(), found.column("block").to_pylist()))
        best = np.argsort(-(users @ items.T), axis=1)[:, :5 + seen]
        assert {(user % 3, block[item]) for user in range(90) for item in best[user].tolist()} <= asked
        assert len(asked) <= 3 * len(cones.block) / 4


def test_rows_of_items_are_small(spark, monkeypatch):
    """However large a block is, its rows are not, because Arrow hands over a fixed number of rows at a time."""
    monkeypatch.setattr(factors, "ROW", 160)
    rng = np.random.default_rng(17)
    users, items = ([(i, row) for i, row in enumerate(rng.normal(size=(size, 4)).tolist())] for size in (30, 200))
    dealt = factors._dealt(vectors(spark, items), 100)[0]
    assert max(row["count"] for row in dealt.groupBy("block", "piece").count().collect()) <= 4
    found = score_topn(vectors(spark, users), vectors(spark, items), 5, 10, 100)
    assert sorted((r["userId"], r["movieId"], r["rank"]) for r in found.collect()) == brute(users, items, 5)


def test_lists_are_put_in_order_some_at_a_time():
    """Beside its lists a group of users takes little memory, however many pairs wait."""
    rng = np.random.default_rng(19)
    users, items = 1 + rng.random((factors.USER_LIMIT, 4)), 1 + rng.random((3000, 4))
    nothing = np.zeros(0, np.int64)
    lists = factors.Lists(np.arange(len(users)), users, (nothing, nothing), 20)
    tracemalloc.start()
    try:
        for at in range(0, len(items), 500):
            lists.offer(np.arange(at, at + 500), items[at:at + 500], np.full(len(users), np.inf))
        for _ in lists.batches():
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 160e6
    some = rng.choice(len(users), 50, replace=False)
    assert [row.tolist() for row in lists.item[some]] == np.argsort(-(users[some] @ items.T), axis=1, kind="stable")[:, :20].tolist()


def test_training_blocks_fit_a_task(spark, monkeypatch):
    """216 million ratings: a block has at most 6 million, and at most 512 MB of factors whatever the rank."""
    asked = []

    class Counted:
        sparkSession = spark

        def count(self):
            return 216_000_000

    class Stopped:
        def __init__(self, **settings):
            asked.append((settings["numUserBlocks"], settings["numItemBlocks"]))

        def fit(self, frame):
            return None

    monkeypatch.setattr(als, "ALS", Stopped)
    for rank in (5, 10, 30, 100):
        als.train_als(Counted(), AlsConfig(rank=rank))
        assert asked[-1][0] == asked[-1][1] and 216_000_000 / asked[-1][0] <= min(6_000_000, 512_000_000 / (4 * rank + 20))
    assert asked[1][0] == 36
