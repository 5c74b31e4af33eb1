"""Connected components of a graph given by its edges, as rounds of star operations on DataFrames.

Large-star ties every larger neighbour of a node to the smallest of its neighbourhood, small-star every smaller
one; alternating them turns each component into a star around its smallest node in a number of rounds
that grows with the logarithm of the number of nodes. Every round is written to the shared folder, so lineage
stays short and a lost executor repeats one round. The smallest neighbours are written before they are joined
to the edges: both sides of that join are then read afresh, and Spark can split a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.session import work_dir


def _stored(df: DataFrame, place: str) -> DataFrame:
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def _star(edges: DataFrame, large: bool, place: str) -> DataFrame:
    """``edges`` has u > v. Each node's neighbours on one side go to the smallest neighbour, or the node if smaller."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.where("v > u").join(_stored(least, f"{place}/least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(_stored(least, f"{place}/least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            edges.sparkSession.read.parquet(f"{place}/least"))
    return _stored(tied.where("u > v").distinct(), f"{place}/edges")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``root`` (the smallest id of its component) of every node other than a root; edges are columns a and b."""
    place = work_dir(edges.sparkSession, "components")
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = _stored(edges, f"{place}/0")
    mark, turn = None, 0
    while True:
        turn += 1
        edges = _star(edges, True, f"{place}/{turn}-large")
        edges = _star(edges, False, f"{place}/{turn}-small")
        # Both sums wrap around; a round that changes no edge leaves them and the count as they are.
        seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                         F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
        if seen == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = seen
