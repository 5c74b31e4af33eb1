"""First load: files to users, movies, ratings and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.operators.aggregates import distinct_user_ids, movie_stats
from tastemill.operators.filters import parse_or_reject
from tastemill.operators.joins import resolve_ids, stage_movies, unmapped
from tastemill.operators.upsert import (
    apply_movie_stats,
    stage_users,
    upsert_catalogue,
    upsert_ratings,
    upsert_users,
)
from tastemill.session import enable_checkpoints
from tastemill.sources.files import split_malformed


@dataclass(frozen=True)
class Imported:
    """The tables after the load, and the rows that were left out."""

    user: DataFrame
    movie: DataFrame
    rating: DataFrame
    rejected_movies: DataFrame
    rejected_ratings: DataFrame
    unmapped_ratings: DataFrame
    malformed: DataFrame | None = None  # file and text of lines with too few or too many fields, if the files tell


def import_files(files: dict[str, DataFrame], user: DataFrame, movie: DataFrame, rating: DataFrame,
                 now: Column | None = None) -> Imported:
    """Merge the three files into the tables. Of a rating given twice the later one counts.

    If movies and links have a column ``arrival``, of lines with one id the last counts.

    The two dimensions are checkpointed once: ratings are mapped through their ids several times.
    """
    enable_checkpoints(user.sparkSession)
    moment = F.current_timestamp() if now is None else now
    files, malformed = split_malformed(files)
    movies, bad_movies = parse_or_reject(files["movies"], {"movieId": "bigint"})
    links, _ = parse_or_reject(files["links"], {"movieId": "bigint"})
    ratings, bad_ratings = parse_or_reject(
        files["ratings"], {"userId": "bigint", "movieId": "bigint", "rating": "decimal(2,1)", "timestamp": "bigint"})

    order = {name: ("arrival",) if "arrival" in files[name].columns else () for name in ("movies", "links")}
    staged = stage_movies(movies, links, order["links"], order["movies"])
    all_movies = upsert_catalogue(movie, staged, moment, order["movies"]).checkpoint()
    ids = distinct_user_ids(files["ratings"]).withColumnRenamed("userId", "mlUserId")
    all_users = upsert_users(user, stage_users(ids), moment).checkpoint()

    all_ratings = upsert_ratings(rating, resolve_ids(ratings, all_users, all_movies), moment)
    rated_movies = apply_movie_stats(all_movies, movie_stats(all_ratings), moment)
    return Imported(all_users, rated_movies, all_ratings, bad_movies, bad_ratings,
                    unmapped(ratings, all_users, all_movies), malformed)
