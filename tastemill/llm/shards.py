"""Documents dealt into shards of about equal bytes by a k-d tree over their metadata.

The tree starts with all shards at its root. A node with several shards is cut at the weighted median (the
place where the bytes on its left are the share of its left shards) along the dimension in which its
documents spread widest, until every leaf is one shard of the target size. Dimensions are document id, size,
language and source, each scaled to the whole table's range; languages and sources count by their place among the
distinct ones.

Points of the tree are groups of equal texts, with the smallest id, language and source of their documents, so
copies stay in one shard. Groups heavier than ``1 / PIECES`` of a shard would upset its cuts. The heaviest first, each goes
whole to the shard with most room left, and the tree fills what room remains: the share of a node's left shards is
their share of its room. Only a group that fits into no shard's room is cut, into pieces of ``1 / PIECES`` of a shard by
a hash of the document id, which are points of the tree. A single row can't be cut; where it is larger than a shard, the
others share the rest equally.

Medians are found without sorting or gathering points: all nodes of a level are cut together, and each round
sums the bytes in ``BINS`` bins of every node's current range and goes on in the bin that holds the median. The
driver sees at most ``BINS`` sums a node and round. Equal values are told apart by a hash of the text, so a cut
can fall between them.

Null texts weigh 8 bytes and are one group of equal texts; null metadata sorts first. Repeated rows are kept.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastemill.llm.registry import query, table
from tastemill.operators.numbering import dense_index
from tastemill.session import work_dir

SHARDS = 24
BINS = 2048
PIECES = 20
DIMENSIONS = ("doc", "size", "lang", "source")


def ranked(points: DataFrame, name: str) -> DataFrame:
    """The column of texts as its place among the distinct texts, whole texts compared by their bytes; null is -1."""
    values = points.select(F.col(name).alias("value")).where("value is not null").distinct()
    places = dense_index(values, "value", "at")  # one row a distinct text
    joined = points.join(places, F.col(name) == F.col("value"), "left")
    return joined.withColumn(name, F.coalesce(F.col("at").cast("double"), F.lit(-1.0))).drop("value", "at")


def base_rows(docs: DataFrame) -> DataFrame:
    """Size, checksum, text key and metadata of every document; texts are read once and not kept."""
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8
    optional = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    return docs.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("doc"),
        optional["lang"].alias("lang"), optional["source"].alias("source"))


def points(rows: DataFrame, target: float) -> DataFrame:
    """Groups of equal texts with their bytes; heavy ones as several pieces."""
    first = {c: F.min(F.struct(F.col(c).isNotNull().alias("given"), F.col(c).alias("value"))) for c in ("lang", "source")}
    groups = rows.groupBy("h1", "h2", "size").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("docs"), F.min("doc").alias("doc"), *(x["value"].alias(c) for c, x in first.items()))
    place = work_dir(rows.sparkSession, "groups")
    groups.write.parquet(place)  # read for the distinct values, and afresh so that Spark can split a common one in the join
    groups = rows.sparkSession.read.parquet(place)
    for c in first:
        groups = ranked(groups, c)
    pieces = F.ceil(F.col("bytes") * F.lit(PIECES) / F.lit(target)).cast("int")
    pieces = F.when(F.col("bytes") * PIECES > target, pieces).otherwise(1)
    return groups.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "h1", "h2", "docs", "pieces", "piece", (F.col("bytes") / F.col("pieces")).alias("weight"),
        F.col("doc"), F.log2(F.col("size").cast("double")).alias("size"), "lang", "source",
        F.pmod(F.xxhash64("h1", "h2", "piece"), F.lit(1 << 40)).cast("double").alias("tie"))


def settle(heavy: list[tuple[float, int, int, int]], n_shards: int, target: float) -> tuple[list[tuple[int, int, int]], list[float]]:
    """The shard of each heavy group (bytes, rows, two hashes) that stays whole, and the bytes each shard still has room for."""
    room = [(-target, k) for k in range(n_shards)]  # a heap, most room first
    placed = []
    for size, docs, h1, h2 in sorted(heavy, key=lambda g: (-g[0], *g[2:])):
        left, k = room[0]
        if size <= -left or docs == 1:
            heapq.heapreplace(room, (left + size, k))
            placed.append((h1, h2, k))
    return placed, [max(-left, 0.0) for _, left in sorted((k, left) for left, k in room)]


def _case(values: dict[int, object], node: str = "node") -> Column:
    """The value of a row's node, from one literal a node."""
    items = [F.lit(x) for pair in values.items() for x in pair]
    return F.create_map(*items)[F.col(node)]


def _dimension(choice: dict[int, str]) -> Column:
    out = F.lit(None).cast("double")
    for name in DIMENSIONS:
        nodes = [n for n, c in choice.items() if c == name]
        if nodes:
            out = F.when(F.col("node").isin(nodes), F.col(name)).otherwise(out)
    return out


def _search(at_nodes: DataFrame, goal: dict[int, float], low: dict[int, float], high: dict[int, float], value: Column,
            within: Column) -> tuple[dict[int, float], dict[int, float], dict[int, float]]:
    """For each node the least value up to which its points reach the goal in bytes; the bytes below it and at it.

    Bins are narrowed until a node's bin is one value wide in the precision of doubles.
    """
    below, inside = dict.fromkeys(goal, 0.0), {}
    cut, open_ = dict(low), {n for n in goal if low[n] < high[n]}
    low, high = dict(low), dict(high)
    while open_:
        width = {n: (high[n] - low[n]) / BINS for n in open_}
        lows, widths = _case({n: low[n] for n in open_}), _case(width)
        rows = at_nodes.where(F.col("node").isin(sorted(open_)) & within).withColumn("v", value)
        rows = rows.where((F.col("v") >= lows) & (F.col("v") <= _case({n: high[n] for n in open_})))
        bins = rows.withColumn("bin", F.least(F.floor((F.col("v") - lows) / widths), F.lit(BINS - 1))).groupBy("node", "bin").agg(
            F.sum("weight").alias("w"), F.min("v").alias("least"), F.max("v").alias("most"))
        found: dict[int, list] = {}
        for row in bins.collect():  # at most BINS rows a node
            found.setdefault(row["node"], []).append((row["bin"], row["w"], row["least"], row["most"]))
        for n in list(open_):
            total = below[n]
            for _, weight, least, most in sorted(found[n]):
                if total + weight >= goal[n] or (least, most) == max((x[2], x[3]) for x in found[n]):
                    break
                total += weight
            below[n], cut[n], inside[n] = total, least, weight
            low[n], high[n] = least, most
            if least >= most:
                open_.discard(n)
    return cut, below, inside


def _left_share(first: int, k: int, room: list[float]) -> float:
    own, left = sum(room[first:first + k]), sum(room[first:first + k // 2])
    return left / own if own else (k // 2) / k


def cut_level(placed: DataFrame, shards: dict[int, int], ranges: dict[str, tuple[float, float]], room: list[float]) -> dict[int, tuple]:
    """For each node with several shards: dimension, value and tie hash of its cut, and the shards on the left."""
    nodes = sorted(n for n, k in shards.items() if k > 1)
    at_nodes = placed.where(F.col("node").isin(nodes))
    stats = at_nodes.groupBy("node").agg(
        F.sum("weight").alias("w"), *(f(c).alias(f"{name}_{c}") for c in (*DIMENSIONS, "tie") for name, f in (("lo", F.min), ("hi", F.max))))
    stats = {r["node"]: r for r in stats.collect()}
    choice = {}
    for n in stats:
        spread = {c: (stats[n][f"hi_{c}"] - stats[n][f"lo_{c}"]) / max(ranges[c][1] - ranges[c][0], 1e-300) for c in DIMENSIONS}
        choice[n] = max(DIMENSIONS, key=lambda c: (spread[c], -DIMENSIONS.index(c)))
    goal = {n: stats[n]["w"] * _left_share(n, shards[n], room) for n in stats}
    value = _dimension(choice)
    cut, below, _ = _search(at_nodes, goal, {n: stats[n][f"lo_{choice[n]}"] for n in stats},
                         {n: stats[n][f"hi_{choice[n]}"] for n in stats}, value, F.lit(True))
    # Among the points of exactly that value, those with a smaller hash go left; the one at the goal goes where it fits better.
    tied = value == _case(cut)
    ties, under, at = _search(at_nodes, {n: goal[n] - below[n] for n in stats}, {n: stats[n]["lo_tie"] for n in stats},
                      {n: stats[n]["hi_tie"] for n in stats}, F.col("tie"), tied)
    fits = {n: goal[n] - below[n] - under[n] > at.get(n, np.inf) / 2 for n in stats}
    return {n: (choice[n], cut[n], ties[n] + (0.5 if fits[n] else 0), shards[n] // 2) for n in stats}


def grow_tree(spark: SparkSession, pts: DataFrame, n_shards: int, place: str, room: list[float] | None = None) -> DataFrame:
    """Points with their ``shard``, in proportion to each shard's ``room``. Shards of nodes without points stay empty."""
    room = room or [1.0] * n_shards
    ends = pts.agg(*(f(c).alias(f"{name}_{c}") for c in DIMENSIONS for name, f in (("lo", F.min), ("hi", F.max)))).first()
    ranges = {c: (ends[f"lo_{c}"] or 0.0, ends[f"hi_{c}"] or 0.0) for c in DIMENSIONS}
    placed = pts.withColumn("node", F.lit(0))  # a node is named by its first shard
    shards, level = {0: n_shards}, 0
    while any(k > 1 for k in shards.values()):
        cuts = cut_level(placed, shards, ranges, room)
        if not cuts:
            break
        value = _dimension({n: c[0] for n, c in cuts.items()})
        at, tie = _case({n: c[1] for n, c in cuts.items()}), _case({n: c[2] for n, c in cuts.items()})
        right = (value > at) | ((value == at) & (F.col("tie") >= tie))
        step = F.coalesce(_case({n: c[3] for n, c in cuts.items()}), F.lit(0))
        placed = placed.withColumn("node", F.when(right, F.col("node") + step).otherwise(F.col("node")).cast("int"))
        placed.write.parquet(f"{place}/level={level}")
        placed = spark.read.parquet(f"{place}/level={level}")
        level += 1
        occupied = {r["node"] for r in placed.select("node").distinct().collect()}  # at most one row a shard
        shards = {m: k for n, total in shards.items() for m, k in (
            [(n, total)] if n not in cuts else [(n, cuts[n][3]), (n + cuts[n][3], total - cuts[n][3])])}
        shards = {n: k for n, k in shards.items() if k == 1 or n in occupied}
    return placed.withColumnRenamed("node", "shard")


def slots(rows: DataFrame, buckets: int) -> DataFrame:
    """A gapless ``slot`` from 0 in each shard. Rows are numbered within buckets of a hash, the buckets one after another."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("k")).select(
        "shard", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "h1", "h2")
    # At most one row a shard and bucket, however large the table.
    return rows.withColumn("at", F.row_number().over(own)).join(F.broadcast(sizes), ["shard", "bucket"]).withColumn(
        "slot", F.col("before") + F.col("at") - 1)


def shard_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every document."""
    spark = docs.sparkSession
    place = work_dir(spark, "shards")
    base_rows(docs).write.parquet(f"{place}/rows")
    rows = spark.read.parquet(f"{place}/rows")
    total = rows.agg(F.sum("size").alias("x")).first()["x"] or 0
    target = max(total / n_shards, 1)
    points(rows, target).write.parquet(f"{place}/points")
    pts = spark.read.parquet(f"{place}/points")
    # Groups of several pieces weigh more than a part of a shard each, so there are at most shards times PIECES of them.
    first = pts.where("pieces > 1 and piece = 0").select("h1", "h2", "docs", "pieces", (F.col("weight") * F.col("pieces")).alias("bytes"))
    heavy = first.collect()
    whole, room = settle([(r["bytes"], r["docs"], r["h1"], r["h2"]) for r in heavy], n_shards, target)
    whole = spark.createDataFrame(whole, "h1 long, h2 long, fixed int")
    tree = pts.join(F.broadcast(whole), ["h1", "h2"], "left_anti")
    placed = grow_tree(spark, tree, n_shards, place, room)
    # Rows of whole groups know their shard; after this no join key holds more than a piece.
    known = first.join(F.broadcast(whole), ["h1", "h2"], "left").select("h1", "h2", "pieces", "fixed")
    rows = rows.join(F.broadcast(known), ["h1", "h2"], "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    settled = rows.where("fixed is not null").withColumn("shard", F.col("fixed"))
    joined = rows.where("fixed is null").join(placed.select("h1", "h2", "piece", "shard"), ["h1", "h2", "piece"]).unionByName(settled).drop("fixed")
    return slots(joined, int(spark.conf.get("spark.sql.shuffle.partitions"))).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


@query("op9_sharding")
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = shard_documents(table(spark, folder, "documents"))
    return found.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
