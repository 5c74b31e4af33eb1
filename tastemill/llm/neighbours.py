"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into balanced parts: recursive bisection, each by the
second eigenvector of the graph's averaging step and a few rounds of swaps that cut fewer edges and keep the
halves equal. A small network with one hidden layer then learns, for a vector, in which parts its neighbours
lie. It places every row of the table in its most probable part, and sends each query to its several most
probable ones, as many as the sample's held-out queries need for ``GOAL`` of their neighbours, and for ``LEAST`` of
them with two standard errors to spare, so that few held-out queries ask for more parts. There all candidates
are compared exactly, in double precision.

The sample is at most ``SAMPLE`` rows chosen by a hash of the id, so is the number of parts; every row is
indexed. Parts are cut into blocks of candidates and of queries, every pair of which is a unit of work, so a
part that holds a third of all rows is many units of bounded size. A query that has not found k candidates is
searched again in all parts.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id or
of another length than most. Rows of one id and vector count once; queries of one id are one query, that of
the smallest vector. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastemill.llm.grouped import sorted_groups
from tastemill.llm.registry import query, table
from tastemill.session import work_dir

K = 5
EVERY = 50
SAMPLE = 8192
PART_ROWS = 128  # sample rows in a part
HIDDEN = 128
NEAR = 10
GOAL, LEAST = 0.95, 0.9
CANDIDATES, QUERIES = 16_384, 4_096


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest other rows of every row, nearest first."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        near = x[a:a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
        out[a:a + len(near)] = np.take_along_axis(top, order, axis=1)
    return out


def _bisect(a: np.ndarray, b: np.ndarray, n: int, share: float, rng: np.random.Generator) -> np.ndarray:
    """Left side of a balanced cut of a graph with edges a–b: a mask of ``share`` of the nodes."""
    degree = np.bincount(a, minlength=n) + 1.0
    x = rng.normal(size=n)
    for _ in range(60):  # averaging over neighbours, without the constant vector
        x = (x + np.bincount(a, x[b], n)) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.linalg.norm(x) + 1e-300
    left = np.zeros(n, bool)
    left[np.argsort(x, kind="stable")[:round(n * share)]] = True
    for _ in range(8):  # swap the nodes that gain most on either side, while a pair gains
        inner = np.bincount(a, (left[a] == left[b]).astype(float), n)
        gain = np.bincount(a, minlength=n) - 2 * inner
        from_left, from_right = (side[np.argsort(-gain[side], kind="stable")] for side in (np.flatnonzero(left), np.flatnonzero(~left)))
        pairs = min(len(from_left), len(from_right))
        good = int((gain[from_left[:pairs]] + gain[from_right[:pairs]] > 2).sum() // 2)
        if not good:
            break
        left[from_left[:good]], left[from_right[:good]] = False, True
    return left


def balanced_parts(near: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Part of every row; parts differ in size by rounding only."""
    n = len(near)
    a = np.repeat(np.arange(n), near.shape[1])
    b = near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    out, rng, todo = np.zeros(n, np.int64), np.random.default_rng(seed), [(np.arange(n), 0, parts)]
    while todo:
        own, first, k = todo.pop()
        out[own] = first
        if k > 1:
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = (place[a] >= 0) & (place[b] >= 0)
            left = _bisect(place[a[inside]], place[b[inside]], len(own), (k // 2) / k, rng)
            todo += [(own[left], first, k // 2), (own[~left], first + k // 2, k - k // 2)]
    return out


@dataclass(frozen=True)
class Router:
    """Probabilities of parts for unit vectors, and how many parts a query is sent to."""

    layers: tuple[np.ndarray, ...]
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of every vector, the most probable first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")


def train_router(x: np.ndarray, parts: np.ndarray, near: np.ndarray, n_parts: int, seed: int = 9, steps: int = 400) -> tuple[np.ndarray, ...]:
    """Fit the network to the shares of parts among each row and its neighbours, by Adam on batches."""
    rng = np.random.default_rng(seed)
    target = np.zeros((len(x), n_parts), np.float32)
    np.add.at(target, (np.arange(len(x)), parts), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), parts[near].ravel()), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    sizes = (x.shape[1], HIDDEN, n_parts)
    params = [rng.normal(0, np.sqrt(2 / sizes[0]), sizes[:2]), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), sizes[1:]), np.zeros(n_parts)]
    params = [p.astype(np.float32) for p in params]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), min(512, len(x)))
        hidden = np.maximum(x[at] @ params[0] + params[1], 0)
        out = hidden @ params[2] + params[3]
        p = np.exp(out - out.max(axis=1, keepdims=True))
        pull = (p / p.sum(axis=1, keepdims=True) - target[at]) / len(at)
        back = (pull @ params[2].T) * (hidden > 0)
        for k, slope in enumerate((x[at].T @ back, back.sum(axis=0), hidden.T @ pull, pull.sum(axis=0))):
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.999 * square[k] + 0.001 * slope ** 2
            params[k] = params[k] - 0.005 * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return tuple(p.astype(np.float32) for p in params)


def fit(x: np.ndarray, k: int = K, goal: float = GOAL) -> Router:
    """Parts and network from unit vectors of the sample; probes from rows that took no part in either."""
    n_parts = max(1, len(x) // PART_ROWS)
    if n_parts == 1:
        return Router(tuple(np.zeros(s, np.float32) for s in ((x.shape[1], 1), 1, (1, 1), 1)), 1)
    asked = np.arange(len(x)) % 8 == 0
    base, queries = x[~asked], x[asked]
    near = neighbour_graph(base, min(NEAR, len(base) - 1))
    layers = train_router(base, balanced_parts(near, n_parts), near, n_parts)
    router = Router(layers, 1)
    placed = router.order(base)[:, 0]
    true = np.argsort(-(queries @ base.T), axis=1)[:, :k]
    rank = np.argsort(router.order(queries), axis=1)  # place of each part in a query's order
    needed = np.take_along_axis(rank, placed[true], axis=1)
    recall = np.array([(needed < probes).mean(axis=1) for probes in range(1, n_parts + 1)])  # of every query
    mean, error = recall.mean(axis=1), recall.std(axis=1) / np.sqrt(len(queries))
    return Router(layers, int(np.argmax((mean >= goal) & (mean - 2 * error >= LEAST))) + 1)


def usable(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows that take part (``vec_id``, ``vec``), and the length of their vectors."""
    fine = F.col(column).isNotNull() & F.forall(
        column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(column, lambda v: v != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).alias("vec"))
    size = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return (rows.where(F.size("vec") == size["d"]), size["d"]) if size else (rows, 0)


def sample_of(rows: DataFrame, most: int) -> np.ndarray:
    """Unit vectors of up to about ``most`` rows chosen by a hash of the id, in order of the id."""
    n = rows.count()
    chance = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    found = rows.where(chance < 0.95 * most / n).select("vec_id", "vec").orderBy("vec_id", "vec").limit(most).collect() if n > most else \
        rows.orderBy("vec_id", "vec").collect()
    return unit(np.array([r["vec"] for r in found], np.float64))


def _matrix(column: pa.Array, dimension: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dimension)


def place(rows: DataFrame, router: Router, dimension: int, kind: str, every: int) -> DataFrame:
    """Part of every row, and the parts a query is sent to (null for other rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dimension)
            order = router.order(unit(x))
            asked = batch.column(0).to_numpy() % every == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([row.tobytes() for row in x], pa.binary()), pa.array(order[:, 0], pa.int32()),
                 pa.array([o[:router.probes].tolist() if a else None for o, a in zip(order, asked)], pa.list_(pa.int32()))],
                names=["vec_id", "vec", "part", "probes"])

    return rows.mapInArrow(run, "vec_id long, vec binary, part int, probes array<int>")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b in double precision; equal rows give equal numbers."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_of_block(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest candidates of every query, as query numbers, candidate numbers and cosines."""
    order = np.argsort(ids, kind="stable")
    _, group = np.unique(np.ascontiguousarray(x[order]).view(f"V{x.dtype.itemsize * x.shape[1]}").ravel(), return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[by_group], group[by_group])
    keep = np.zeros(len(ids), bool)
    keep[order[by_group[np.arange(len(ids)) - begin <= k]]] = True  # of equal vectors no more than k and the query's own can matter
    kept = np.flatnonzero(keep)
    wide, asked_wide = x[kept].astype(np.float64), q.astype(np.float64)
    wide /= np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    asked_wide /= np.sqrt((asked_wide * asked_wide).sum(axis=1, keepdims=True))
    out = []
    for a in range(0, len(q), 256):
        near = asked_wide[a:a + 256] @ wide.T
        near[asked[a:a + 256, None] == ids[kept]] = -np.inf
        most = min(k, len(kept))
        least = -np.partition(-near, most - 1, axis=1)[:, most - 1:most]
        who, what = np.nonzero((near >= least - 1e-9) & np.isfinite(near))  # with all near ties, then exactly
        who = who + a
        score = cosines(q[who], x[kept[what]])
        order = np.lexsort((ids[kept[what]], -score, who))
        who, what, score = who[order], kept[what[order]], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        out.append((who[rank < k], what[rank < k], score[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*out))


def search(candidates: DataFrame, queries: DataFrame, dimension: int, kind: str, k: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``score`` of the k nearest candidates of each query in each block.

    Candidates have ``part``; queries have one row for each part they are sent to.
    """
    sizes = {r["part"]: (r["c"], r["q"]) for r in candidates.select("part", F.lit(1).alias("c"), F.lit(0).alias("q")).unionAll(
        queries.select("part", F.lit(0), F.lit(1))).groupBy("part").agg(F.sum("c").alias("c"), F.sum("q").alias("q")).collect()}
    blocks = {p: (-(-c // CANDIDATES) or 1, -(-q // QUERIES) or 1) for p, (c, q) in sizes.items()}  # one entry a part

    def number(which: int):
        return F.create_map(*[F.lit(x) for p, n in sorted(blocks.items()) for x in (p, n[which])])[F.col("part")]

    own = lambda n: F.pmod(F.xxhash64("vec_id", "vec"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = candidates.select("part", own(number(0)).alias("cb"), each(number(1)).alias("qb"), F.lit(0).alias("side"), "vec_id", "vec")
    right = queries.select("part", each(number(0)).alias("cb"), own(number(1)).alias("qb"), F.lit(1).alias("side"), "vec_id", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begins in sorted_groups(batches, 3):
            ids, side = batch.column(4).to_numpy(), batch.column(3).to_numpy()
            for a, b in zip(begins[:-1], begins[1:]):
                cut = a + int((side[a:b] == 0).sum())
                if a < cut < b:
                    x, q = (_matrix(batch.column(5).slice(s, e - s), dimension, kind) for s, e in ((a, cut), (cut, b)))
                    who, what, score = best_of_block(ids[a:cut], x, ids[cut:b], q, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[cut:b][who]), pa.array(ids[a:cut][what]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return left.unionAll(right).repartition("part", "cb", "qb").sortWithinPartitions("part", "cb", "qb", "side", "vec_id", "vec").mapInArrow(
        run, "query_id long, vec_id long, score double")


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, column: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest found of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    folder = work_dir(spark, "neighbours")
    kind = "<f8" if vectors.schema[column].dataType.elementType.typeName() == "double" else "<f4"
    rows, dimension = usable(vectors, column)
    schema = "query_id long, rank int, vec_id long, score double"
    if not dimension:
        return spark.createDataFrame([], schema)
    router = fit(sample_of(rows, sample), k)
    place(rows, router, dimension, kind, every).write.parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    placed.where("probes is not null").groupBy("vec_id").agg(F.min(F.struct("vec", "probes")).alias("q")).select(
        "vec_id", "q.*").write.parquet(f"{folder}/queries")
    queries = spark.read.parquet(f"{folder}/queries")
    candidates = placed.select("vec_id", "vec", "part")
    found = search(candidates, queries.select("vec_id", "vec", F.explode("probes").alias("part")), dimension, kind, k)
    top(found, k).write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") == k)
    short = queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti")
    parts = [r["part"] for r in candidates.select("part").distinct().collect()]  # at most as many as the sample has parts
    everywhere = short.select("vec_id", "vec", F.explode(F.array(*[F.lit(p) for p in sorted(parts)])).alias("part"))
    more = top(search(candidates, everywhere, dimension, kind, k), k)
    complete = found.join(full.select("query_id"), "query_id", "left_semi")
    return complete.unionByName(more).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op10_approximate_neighbours")
def op10_approximate_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))
