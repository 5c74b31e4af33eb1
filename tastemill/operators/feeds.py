"""Merging item feeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_feeds(feeds: Sequence[tuple[str, DataFrame]], key: str = "id") -> DataFrame:
    """All feeds as one, each id once; the feed named first wins."""
    marked = [
        df.withColumns({"feed": F.lit(name), "priority": F.lit(place)}) for place, (name, df) in enumerate(feeds)
    ]
    union = reduce(DataFrame.unionByName, marked)
    rest = [name for name in union.columns if name not in (key, "priority")]
    first = F.min(F.struct("priority", *rest)).alias("first")
    return union.groupBy(key).agg(first).select(key, *[f"first.{name}" for name in rest])


def new_items(feed: DataFrame, movie: DataFrame, key: str = "id") -> DataFrame:
    """Items of a feed whose id no movie carries yet."""
    known = movie.where(F.col("tmdbId").isNotNull()).select("tmdbId")
    wanted = feed.withColumn("tmdbId", F.col(key).cast("string"))
    return wanted.join(known, "tmdbId", "left_anti").select(*feed.columns)
