"""Similarity join of texts by the Jaccard index of their five-word shingles, with Bayesian pruning of candidates.

1. Every text becomes a set of shingle hashes with a MinHash signature (one pass over the texts). Texts with
   equal sets are copies and go on as one set.
2. Signatures are cut into bands; sets with an equal band are candidates. At similarity 0.8, 32 bands of 4
   values miss a pair with probability 5e-8.
3. Within a bucket, signatures are compared 16 values at a time; a pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold is below ``TOLERANCE``. What survives is kept as a
   spanning forest of the bucket (no more edges than members), and forests together give groups.
4. Within a group all pairs are tested the same way and the survivors are verified exactly on whole shingle
   sets, many at once as products of incidence matrices. Each set gets the number of documents it is linked
   with; pairs are never written out.
5. Classes are the connected components of the verified links; copies are in the class of their set.

Buckets and groups larger than a tile are cut into blocks and every pair of blocks is a task of its own, so
memory is bounded and a hot group spreads over the cluster, while no pair of different texts is left out.

A text of fewer than five words is one shingle. Null texts and texts without words are linked with nothing and
are classes of their own. Repeated rows are copies of each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastemill.llm.components import components
from tastemill.llm.grouped import sorted_groups
from tastemill.llm.registry import query, table
from tastemill.llm.textbytes import mix, pieces, shingles
from tastemill.session import work_dir

THRESHOLD = 0.8
WIDTH = 5
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-8
BUCKET_TILE = 4096
GROUP_TILE = 1024

_rng = np.random.default_rng(20240607)
_LOW, _HIGH = (_rng.integers(0, 1 << 31, VALUES, np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of a set of hashes under each of ``VALUES`` hash functions."""
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(hashes), 512):
        values = low[k:k + 512] * _LOW[:, None]
        values += high[k:k + 512] * _HIGH[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, bounds = shingles(column, width)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that do not depend on order: two sums of differently mixed hashes."""
    total = (mix(hashes).sum(dtype=np.uint64), mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    return int(total[0].astype(np.int64)), int(total[1].astype(np.int64))


def profiles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Key, size, signature (a byte of each MinHash value) and bands of the set of every text; ``text_hash`` tells rows of
    one id with different texts apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = sets(piece.column(1), width)
            keys = [set_key(s) if len(s) else (None, None) for s in found]
            least = np.stack([minhashes(s) for s in found])
            joined = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
            band = np.arange(BANDS, dtype=np.uint64)[None]
            for k in range(ROWS):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + joined[:, :, k])
            short = ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([len(s) for s in found], pa.int64()), pa.array([row.tobytes() for row in short], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS),
                                          pa.array(band.view(np.int64).ravel()))],
                names=["doc_id", "text_hash", "hi", "lo", "n", "sig", "bands"])

    return with_text_hash(docs).mapInArrow(
        run, f"doc_id {kind}, text_hash long, hi long, lo long, n long, sig binary, bands array<long>")


def with_text_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def same_row(one: str, other: str) -> Column:
    """Rows of one id and text, ids compared with nulls."""
    return (F.col(f"{one}.text_hash") == F.col(f"{other}.text_hash")) & F.col(f"{one}.doc_id").eqNullSafe(F.col(f"{other}.doc_id"))


@lru_cache(maxsize=8)
def needed_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each number of compared values (a step apart) the fewest matches with which a pair goes on.

    The prior of the similarity is uniform; two different values agree in their byte one time in 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        for k in range(n + 1):
            like = k * np.log(p) + (n - k) * np.log1p(-np.minimum(p, 1 - 1e-15))
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() >= tolerance * like.sum():
                break
        out.append(k)
    return tuple(out)


def plausible(left: np.ndarray, right: np.ndarray, need: tuple[int, ...]) -> np.ndarray:
    """Which pairs of rows of two lists of signatures survive all steps, as a matrix."""
    out = np.zeros((len(left), len(right)), bool)
    a, b = (x.ravel() for x in np.indices(out.shape))
    matches = np.zeros(len(a), np.int16)
    for step, least in enumerate(need):
        part = slice(step * STEP, (step + 1) * STEP)
        matches += (left[a, part] == right[b, part]).sum(axis=1, dtype=np.int16)
        keep = matches >= least
        a, b, matches = a[keep], b[keep], matches[keep]
    out[a, b] = True
    return out


def forest(sig: np.ndarray, need: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the graph of surviving pairs: breadth first, testing only nodes not yet reached."""
    rest, parents, found = np.arange(len(sig)), [], []
    while len(rest) > 1:
        queue, rest = rest[:1], rest[1:]
        while len(queue) and len(rest):
            block, queue = queue[:64], queue[64:]
            ok = plausible(sig[block], sig[rest], need)
            hit = ok.any(axis=0)
            parents.append(block[ok[:, hit].argmax(axis=0)])
            found.append(rest[hit])
            queue, rest = np.concatenate([queue, rest[hit]]), rest[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *parents]), np.concatenate([none, *found])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def tiles(df: DataFrame, size: Column, tile: int) -> DataFrame:
    """Rows once for each pair of blocks they belong to (``i`` <= ``j``); a group within one tile has one block."""
    blocks = F.ceil(size / tile).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    return df.withColumn("own", own).withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn(
        "j", F.greatest("own", "other")).drop("other")


def candidate_edges(distinct: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                    tile: int = BUCKET_TILE) -> DataFrame:
    """Edges a, b of spanning forests of the surviving pairs of every bucket."""
    need = needed_matches(threshold, tolerance)
    rows = distinct.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    place = work_dir(distinct.sparkSession, "buckets")
    shared.write.parquet(place)
    # Read afresh, so that Spark can split hot buckets in the join and may broadcast a short list.
    members = rows.join(distinct.sparkSession.read.parquet(place), "bucket").join(distinct.select("id", "sig"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begins in sorted_groups(batches, 3):
            ids, sig = batch.column(3).to_numpy(), _signatures(batch.column(4))
            size = np.diff(begins)
            first = begins[:-1][size == 2]
            matches, a = np.zeros(len(first), np.int16), first
            for step, least in enumerate(need):  # all groups of two at once
                part = slice(step * STEP, (step + 1) * STEP)
                matches += (sig[a, part] == sig[a + 1, part]).sum(axis=1, dtype=np.int16)
                a, matches = a[matches >= least], matches[matches >= least]
            left, right = [ids[a]], [ids[a + 1]]
            for k in np.flatnonzero(size > 2):
                x, y = forest(sig[begins[k]:begins[k + 1]], need)
                left.append(ids[begins[k] + x])
                right.append(ids[begins[k] + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    tiled = tiles(members, F.col("m"), tile).select("bucket", "i", "j", "id", "sig")
    return tiled.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id").mapInArrow(
        run, "a long, b long").distinct()


def intersections(own: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as products of incidence matrices in blocks of columns."""
    size = np.array([len(s) for s in own])
    values, where, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = counts > 1  # a hash of one set alone is in no intersection
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(own)), size)[shared[where]]
    column = place[where[shared[where]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(own), len(own)), np.float32)
    width = 4096
    for k in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [k, k + width])
        block = np.zeros((len(own), min(width, int(shared.sum()) - k)), np.float32)
        block[row[a:b], column[a:b] - k] = 1
        total += block @ block.T
    total[np.arange(len(own)), np.arange(len(own))] = size
    return total


def links(own: list[np.ndarray], sig: np.ndarray, threshold: float, need: tuple[int, ...]) -> np.ndarray:
    """Matrix of verified links between different sets."""
    size = np.array([len(s) for s in own], np.float64)
    if len(own) <= 8:
        ok = np.zeros((len(own), len(own)), bool)
        for a, b in zip(*np.nonzero(np.triu(plausible(sig, sig, need), 1))):
            if min(size[a], size[b]) >= threshold * max(size[a], size[b]) - 1e-9:
                common = len(np.intersect1d(own[a], own[b], assume_unique=True))
                ok[a, b] = ok[b, a] = common * (1 + threshold) >= threshold * (size[a] + size[b]) - 1e-9
        return ok
    ok = np.concatenate([plausible(sig[k:k + 64], sig, need) for k in range(0, len(sig), 64)])
    ok &= intersections(own) * (1 + threshold) >= threshold * (size[:, None] + size) - 1e-9
    np.fill_diagonal(ok, False)
    return ok


def spanning(ok: np.ndarray) -> np.ndarray:
    """For every node the smallest node of its component."""
    root = np.arange(len(ok))
    seen = np.zeros(len(ok), bool)
    for k in range(len(ok)):
        front = np.array([k]) if not seen[k] else np.zeros(0, int)
        seen[k] = True
        while len(front):
            new = np.flatnonzero(ok[front].any(axis=0) & ~seen)
            seen[new], root[new] = True, k
            front = new
    return root


def verified(docs: DataFrame, members: DataFrame, threshold: float, tolerance: float, width: int, tile: int) -> DataFrame:
    """``id``, ``root`` in its tile and number of linked documents in its tile, for each set and tile it is in."""
    need = needed_matches(threshold, tolerance)
    # One row of each set, by id and text, brings the text.
    wanted = members.alias("m").join(with_text_hash(docs).alias("d"), same_row("m", "d")).select(
        "id", "component", "size", "copies", "sig", "hi", "lo", "text")

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of rows that are given many times a task passes one on
        for piece in pieces(batches):
            fresh = [k for k, i in enumerate(piece.column("id").to_pylist()) if not (i in seen or seen.add(i))]
            piece = piece.take(pa.array(fresh, pa.int64()))
            found = sets(piece.column("text"), width)
            keys = zip(piece.column("hi").to_pylist(), piece.column("lo").to_pylist())
            keep = [k for k, (s, key) in enumerate(zip(found, keys)) if len(s) and set_key(s) == key]
            rows = piece.select(["id", "component", "size", "copies", "sig"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([found[k].tobytes() for k in keep], pa.binary())], names=[*rows.schema.names, "hashes"])

    hashed = wanted.mapInArrow(
        hash_sets, "id long, component long, size long, copies long, sig binary, hashes binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begins in sorted_groups(batches, 3):
            ids, block, copies = (batch.column(c).to_numpy() for c in ("id", "own", "copies"))
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            sig = _signatures(batch.column("sig"))
            out_id, out_root, out_links = [], [], []
            for a, b in zip(begins[:-1], begins[1:]):
                _, at = np.unique(ids[a:b], return_index=True)  # one row of each set
                at += a
                own = [np.frombuffer(batch.column("hashes")[int(k)].as_py(), np.uint64) for k in at]
                ok = links(own, sig[at], threshold, need)
                if i[a] != j[a]:  # only pairs across the two blocks are this tile's
                    ok &= block[at][:, None] != block[at]
                out_id.append(ids[at])
                out_root.append(ids[at][spanning(ok)])
                out_links.append(ok @ copies[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in (out_id, out_root, out_links)], names=["id", "root", "links"])

    tiled = tiles(hashed, F.col("size"), tile).select("component", "i", "j", "id", "own", "copies", "sig", "hashes")
    return tiled.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id").mapInArrow(
        compare, "id long, root long, links long")


def _classes(docs: DataFrame, threshold: float, tolerance: float, width: int, bucket_tile: int, group_tile: int) -> DataFrame:
    """Every row's id and text hash, the first row of its class (smallest id, then text hash) and its numbers."""
    spark = docs.sparkSession
    place = work_dir(spark, "jaccard")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        return spark.read.parquet(f"{place}/{name}")

    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    profile = stored(profiles(docs, width), "profiles")
    # The ids of sets are fixed by writing them.
    distinct = stored(profile.where("n > 0").groupBy("hi", "lo", "n").agg(
        F.min(row).alias("row"), F.count("*").alias("copies"), F.first("sig").alias("sig"),
        F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()), "sets")
    edges = stored(candidate_edges(distinct, threshold, tolerance, bucket_tile), "edges")
    found = components(edges)
    members = stored(found.select("id", F.col("root").alias("component")).union(
        found.select("root", "root").distinct()), "members")
    sizes = stored(members.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    # Written, so that Spark knows how few they are when it joins them with the texts.
    members = stored(members.join(sizes, "component").join(
        distinct.select("id", "row.doc_id", "row.text_hash", "hi", "lo", "copies", "sig"), "id"), "wanted")
    checked = stored(verified(docs, members, threshold, tolerance, width, group_tile), "links")
    roots = components(checked.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    total = checked.groupBy("id").agg(F.sum("links").alias("links"))
    labelled = distinct.select("id", "hi", "lo", "n", "row", "copies").join(roots, "id", "left").join(total, "id", "left").select(
        "hi", "lo", "n", "row", "copies", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    labelled = stored(labelled, "labelled")
    named = stored(labelled.groupBy("root").agg(F.min("row").alias("first")), "names")
    labelled = stored(labelled.join(named, "root").select("hi", "lo", "n", "first", "copies", "links"), "classes")
    return profile.select("doc_id", "text_hash", "hi", "lo", "n").join(labelled, ["hi", "lo", "n"], "left")


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, width: int = WIDTH,
                       bucket_tile: int = BUCKET_TILE, group_tile: int = GROUP_TILE) -> DataFrame:
    """One row for each document: ``doc_id``, ``class_id`` (smallest document id of its class), ``n_links`` (documents
    at least ``threshold`` alike, copies included) and ``n_copies`` (documents with the same shingles, itself included)."""
    rows = _classes(docs, threshold, tolerance, width, bucket_tile, group_tile)
    return rows.select(
        "doc_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"))


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, width: int = WIDTH,
                      bucket_tile: int = BUCKET_TILE, group_tile: int = GROUP_TILE) -> DataFrame:
    """The row with the smallest id of each class, with all its columns.

    Of rows of one class and id with different texts the one with the smallest hash of its text stays, of rows of one id and
    text one; rows without words stay. Only ids and hashes decide and travel: rows that go, and
    rows given more than once, are written as narrow keys, and the texts are filtered by them.
    """
    spark = docs.sparkSession
    place = work_dir(spark, "superseded")
    rows = _classes(docs, threshold, tolerance, width, bucket_tile, group_tile)
    first = (F.col("text_hash") == F.col("first.text_hash")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    keys = rows.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n"), F.bool_or(F.col("copies").isNotNull() & ~first).alias("goes"))
    keys.where("goes or n > 1").write.parquet(place)
    marked = spark.read.parquet(place)
    whole = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", F.xxhash64("text").alias("text_hash")).alias("d")
    once = whole.join(marked.alias("m"), same_row("d", "m"), "left_anti")
    again = whole.join(marked.where("not goes").alias("m"), same_row("d", "m"), "left_semi")
    order = Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(1))
    again = again.withColumn("place", F.row_number().over(order)).where("place = 1")
    return once.select("whole.*").unionByName(again.select("whole.*"))


@query("op8_ngram_jaccard_join")
def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_classes(table(spark, folder, "documents"))
