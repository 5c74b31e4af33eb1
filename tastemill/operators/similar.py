"""Similar movies: those whose genres contain the first genre of a movie, best rated first.

The genre test is a substring test, which as a join condition would compare every movie with every
other. A genre holds no separator, so it can only be found inside a single genre of the other movie;
the test is therefore made once per pair of genre words, and movies are joined on words with ``=``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.numbers import or_zero
from tastemill.functions.text import first_genre, folded, genre_list

CARD = ("title", "genres", "year", "posterUrl", "avgRating", "description")


def _order() -> list[Column]:
    return [F.col("avgRating").desc_nulls_last(), F.col("id")]


def top_list(movie: DataFrame, k: int) -> Column:
    """The ``k`` best rated movies as one array of cards, to be used like a constant."""
    card = [name for name in CARD if name in movie.columns]
    best = movie.select("id", *card).orderBy(*_order()).limit(k)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(*_order())))  # over k rows
    return placed.agg(F.array_sort(F.collect_list(F.struct("place", "id", *card))).alias("items")).scalar()


def word_matches(firsts: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs of a first genre and a genre word that contains it, case and accents ignored.

    Every word is spread into its parts and the parts are joined with ``=``, so the work grows with
    the vocabulary and not with its square.
    """
    starts = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    sizes = F.sequence(F.lit(1), F.length("word") - F.col("start") + 1)
    spread = starts.select("word", "start", F.explode(sizes).alias("size")).select(
        "word", F.substring(F.col("word"), F.col("start"), F.col("size")).alias("part"))
    return (
        spread.select("word", folded(F.col("part")).alias("part"))
        .join(firsts.select("first", folded(F.col("first")).alias("part")), "part")
        .select("first", "word")
        .distinct()
    )


def genre_tops(movie: DataFrame, k: int) -> DataFrame:
    """Per first genre: array of the ``k`` best rated movies that contain it.

    The ``k`` best of a union are among the ``k`` best of its parts, so every word is cut to ``k``
    movies first; Spark makes that cut before the shuffle too.
    """
    card = [name for name in CARD if name in movie.columns]
    firsts = movie.select(first_genre(F.col("genres")).alias("first")).where(F.col("first").isNotNull()).distinct()
    tagged = movie.select("id", *card, F.explode(F.array_distinct(genre_list(F.col("genres")))).alias("word"))
    per_word = Window.partitionBy("word").orderBy(*_order())
    best_of_word = tagged.withColumn("place", F.row_number().over(per_word)).where(F.col("place") <= k).drop("place")
    matches = word_matches(firsts, tagged.select("word").distinct())
    found = matches.join(best_of_word, "word").drop("word").dropDuplicates(["first", "id"])
    per_first = Window.partitionBy("first").orderBy(*_order())
    placed = found.withColumn("place", F.row_number().over(per_first)).where(F.col("place") <= k)
    items = F.array_sort(F.collect_list(F.struct("place", "id", *card)))
    return placed.groupBy("first").agg(items.alias("items"))


def similar_items(movie: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most similar movies of every movie.

    A movie without genres, or alone with its genre, gets the best rated movies overall. Each list
    is kept with one movie to spare, because the movie itself has to leave it.
    """
    based = movie.select("id", "title", first_genre(F.col("genres")).alias("first"))
    joined = based.join(genre_tops(movie, k + 1), "first", "left").withColumn("top", top_list(movie, k + 1))
    own = F.filter("items", lambda item: item["id"] != F.col("id"))
    overall = F.filter("top", lambda item: item["id"] != F.col("id"))
    chosen = F.when(F.size(own) > 0, own).otherwise(overall)
    return joined.select(
        F.col("id").alias("baseId"), F.col("title").alias("baseTitle"),
        F.posexplode(F.slice(chosen, 1, k)).alias("place", "item"),
    ).select(
        "baseId", "baseTitle", (F.col("place") + 1).alias("place"), F.col("item.id").alias("id"),
        *[F.col(f"item.{name}").alias(name) for name in CARD if name in movie.columns and name != "avgRating"],
        or_zero(F.col("item.avgRating")).alias("avgRating"))
