"""Similar movies, feeds, pages, staging, checks, the import job."""

import random
import unicodedata

from pyspark.sql import functions as F

from tastemill import schemas
from tastemill.operators import aggregates, feeds, filters, integrity, joins, ranking
from tastemill.operators.similar import similar_items
from tastemill.operators.upsert import apply_movie_stats
from tastemill.plans.importer import import_files
from tastemill.sources.files import read_movielens, seed_movies
from tastemill.config import JdbcConfig
from tastemill.sources.jdbc import read_jdbc_partitioned
from tastemill.sources.warehouse import moment

CARDS = "id bigint, title string, genres string, avgRating double"


def fold(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def similar_by_hand(movies, k):
    def best(rows):
        return [m[0] for m in sorted(rows, key=lambda m: (m[3] is None, -(m[3] or 0), m[0]))[:k]]

    found = {}
    for movie in movies:
        genres = [g for g in (movie[2] or "").split("|") if g]
        others = [m for m in movies if m[0] != movie[0]]
        same = [m for m in others if genres and m[2] is not None and fold(genres[0]) in fold(m[2])]
        found[movie[0]] = best(same) or best(others)
    return found


def test_similar_equals_comparing_all(spark):
    rng = random.Random(5)
    words = ["Sci-Fi", "Sci", "drama", "Drama", "Dráma", "War", "warm", "x", "Film Noir"]
    movies = []
    for i in range(150):
        some = rng.sample(words, rng.randint(0, 3))
        genres = None if rng.random() < 0.1 else "|".join(some)
        movies.append((i, f"m{i}", genres, rng.choice([None, 1.0, 2.0, 3.0, 4.0])))
    movies += [(500, "alone", "Unique", 5.0), (501, "hot", "drama|drama", 4.0)]
    for k in (1, 4):
        rows = similar_items(spark.createDataFrame(movies, CARDS), k).collect()
        found = {}
        for row in sorted(rows, key=lambda r: (r["baseId"], r["place"])):
            found.setdefault(row["baseId"], []).append(row["id"])
        assert found == similar_by_hand(movies, k)


def test_one_movie_has_no_similar(spark):
    assert similar_items(spark.createDataFrame([(1, "a", "X", 1.0)], CARDS), 3).count() == 0


def test_first_feed_wins(spark):
    one = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id bigint, title string")
    two = spark.createDataFrame([(2, "z"), (3, "y")], "id bigint, title string")
    merged = feeds.merge_feeds([("one", one), ("two", two)])
    assert sorted(map(tuple, merged.select("id", "feed", "title").collect())) == [
        (1, "one", "a"), (2, "one", "c"), (3, "two", "y")]
    movie = spark.createDataFrame([("1",), (None,)], "tmdbId string")
    assert sorted(r["id"] for r in feeds.new_items(merged, movie).collect()) == [2, 3]


def test_pages(spark):
    movies = spark.createDataFrame([(3, "b", 1.0), (1, "B", 1.0), (2, "á", 2.0), (4, None, None)],
                                   "id bigint, title string, avgRating double")
    ids = [r["id"] for r in ranking.paginate(movies, ranking.movie_order("avgRating"), 1, 4).collect()]
    assert ids == [2, 1, 3, 4]
    assert [r["id"] for r in ranking.paginate(movies, ranking.movie_order("any"), 1, 3).collect()] == [4, 2, 1]
    assert [r["id"] for r in ranking.paginate(movies, ranking.movie_order("title"), 2, 3).collect()] == [3]
    assert tuple(ranking.page_info(movies, 3).first()) == (4, 2)
    assert tuple(ranking.page_info(movies.limit(0), 3).first()) == (0, 0)


def test_validation_reasons(spark):
    movies = spark.createDataFrame([(0,), (1,)], "id bigint")
    given = [(1, None), (1, 0.5), (0, 1.0), (1, 5.0), (1, 5.5), (1, float("nan")), (9, 3.0), (None, 3.0)]
    ratings = spark.createDataFrame([(i, m, r) for i, (m, r) in enumerate(given)], "n int, movieId bigint, rating double")
    good, bad = filters.validate_ratings(ratings, movies)
    assert sorted(r["n"] for r in good.collect()) == [2, 3]
    assert {r["n"]: r["reason"] for r in bad.collect()} == {
        0: "missing", 1: "out of range", 4: "out of range", 5: "out of range", 6: "unknown movie", 7: "missing"}


def test_id_zero_is_an_id(spark):
    users = spark.createDataFrame([(0, 0), (5, None)], "id bigint, mlUserId bigint")
    movies = spark.createDataFrame([(0, 0)], "id bigint, mlMovieId bigint")
    ratings = spark.createDataFrame([(0, 0, 1.0), (0, 4, 1.0), (None, 0, 1.0)],
                                    "userId bigint, movieId bigint, rating double")
    assert joins.resolve_ids(ratings, users, movies).count() == 1
    assert joins.unmapped(ratings, users, movies).count() == 2


def test_links_last_one_counts(spark):
    movies = spark.createDataFrame([(1, "A (2000)", "X"), (2, "B", "(no genres listed)")],
                                   "movieId bigint, title string, genres string")
    links = spark.createDataFrame([(1, "i1", "t1", 1), (1, "i2", " ", 2)],
                                  "movieId bigint, imdbId string, tmdbId string, line int")
    staged = {r["mlMovieId"]: r for r in joins.stage_movies(movies, links, ("line",)).collect()}
    assert (staged[1]["imdbId"], staged[1]["tmdbId"], staged[1]["year"]) == ("i2", None, 2000)
    assert (staged[2]["imdbId"], staged[2]["genres"], staged[2]["title"]) == (None, None, "B")


def test_user_stats(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    ratings = spark.createDataFrame([(1, 2.0), (1, 2.5)], "userId bigint, rating double").withColumn(
        "rating", F.col("rating").cast("decimal(2,1)"))
    recs = spark.createDataFrame([(1, "ALS"), (1, "ALS"), (3, "ALS")], "userId bigint, algorithm string")
    rows = sorted(map(tuple, aggregates.user_stats(users, ratings, recs).collect()))
    assert rows == [(1, 2, 2, "2.3"), (2, 0, 0, "0.0"), (3, 0, 1, "0.0")]


def test_orphans_and_copies(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "n int, movieId bigint")
    parent = spark.createDataFrame([(1,)], "id bigint")
    assert [r["n"] for r in integrity.orphans(child, parent, "movieId").collect()] == [2]
    assert integrity.duplicate_keys(spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int"), ["k"]).collect() == [
        (1, 2)]
    left = integrity.cascade_delete(parent, "movieId", child)[0]
    assert sorted(r["n"] for r in left.collect()) == [2, 3]


def test_statistics_follow_deleted_users(spark):
    rows = [(1, 10, 4.0), (2, 10, 1.0), (3, 10, 4.5), (1, 11, 5.0), (2, 12, 3.0), (None, 12, 2.0), (1, 12, None), (3, 13, 2.5)]
    ratings = spark.createDataFrame(rows, "userId bigint, movieId bigint, rating double").withColumn(
        "rating", F.col("rating").cast("decimal(2,1)"))
    users = spark.createDataFrame([(k, f"u{k}") for k in (1, 2, 3, 4)], "id bigint, userName string")
    recs = ratings.select("userId", "movieId").withColumn("userName", F.lit("clash"))
    movie = spark.createDataFrame([(m, 0) for m in (10, 11, 12, 13, 14)], "id bigint, updated_at int").withColumns({
        "avgRating": F.lit(0).cast("decimal(3,2)"), "ratingCount": F.lit(0), "gone": F.lit("kept")})
    movie = apply_movie_stats(movie, aggregates.movie_stats(ratings))
    ids = spark.createDataFrame([(1,), (1,), (None,), (99,)], "id bigint")
    left = integrity.delete_users(ids, users, ratings, recs, movie, F.lit(7))
    assert [df.columns for df in left] == [df.columns for df in (users, ratings, recs, movie)]
    assert sorted(r.id for r in left[0].collect()) == [2, 3, 4]
    for child in left[1:3]:
        assert sorted((r.userId or 0, r.movieId) for r in child.collect()) == [(0, 12), (2, 10), (2, 12), (3, 10), (3, 13)]
    assert sorted((r.id, float(r.avgRating), r.ratingCount, r.updated_at) for r in left[3].collect()) == [
        (10, 2.75, 2, 7), (11, 0.0, 0, 7), (12, 2.5, 2, 0), (13, 2.5, 1, 0), (14, 0.0, 0, 0)]
    same = integrity.delete_users(ids.limit(0), users, ratings, recs, movie, F.lit(7))
    assert all(sorted(map(str, a.collect())) == sorted(map(str, b.collect())) for a, b in zip(same, (users, ratings, recs, movie)))


def test_metrics(spark):
    watched, metrics = aggregates.with_metrics(spark.range(10), "seen", even=F.col("id") % 2 == 0)
    watched.write.format("noop").mode("overwrite").save()
    assert metrics.get == {"rows": 10, "even": 5}
    assert aggregates.rows_per_second(10, 2) == 5 and aggregates.rows_per_second(10, 0) == 0


def test_approximate_profile(spark):
    ratings = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "userId bigint, movieId bigint")
    assert aggregates.dataset_profile(ratings).collect() == aggregates.dataset_profile(ratings, True).collect()


def test_seeds(spark):
    seeds = seed_movies(spark)
    assert seeds.count() == 10 and seeds.where("source = 'ML'").count() == 10
    assert float(seeds.where("id = 1").first()["avgRating"]) == 4.8


def test_partitioned_read_settings():
    told = {}

    class Reader:
        def format(self, name):
            told["format"] = name
            return self

        def option(self, key, value):
            told[key] = value
            return self

        def options(self, **more):
            told.update(more)
            return self

        def load(self):
            return told

    class Session:
        read = Reader()

    read = read_jdbc_partitioned(Session(), "jdbc:x", JdbcConfig(1, 162_541), options={"user": "u"})
    assert read == {
        "format": "jdbc", "url": "jdbc:x", "dbtable": "(SELECT userId, movieId, rating FROM rating) AS ranged",
        "partitionColumn": "userId", "lowerBound": 1, "upperBound": 162_541, "numPartitions": 40, "fetchsize": 10000,
        "user": "u"}


MOVIES = '''movieId,title,genres
1,"American President, The (1995)",Comedy|Drama
2,"Foo ""Bar"" (1999)",(no genres listed)
x,Broken,None
'''
LINKS = '''movieId,imdbId,tmdbId
1,0112,
2,0113,77
'''
RATINGS = '''userId,movieId,rating,timestamp
10,1,3.5,100
10,1,4.0,200
11,1,0.5,100
11,2,5.0,100
11,9,5.0,100
12,one,5.0,100
12,1,99,100
'''


def test_import(spark, folder):
    for name, text in (("movies", MOVIES), ("links", LINKS), ("ratings", RATINGS)):
        with open(f"{folder}/{name}.csv", "w", encoding="utf-8") as out:
            out.write(text)
    empty = {name: spark.createDataFrame([], schema) for name, schema in (
        ("user", schemas.USER), ("movie", schemas.MOVIE), ("rating", schemas.RATING))}
    now = moment("2024-06-01 00:00:00")
    result = import_files(read_movielens(spark, folder), **empty, now=now)
    movies = {r["mlMovieId"]: r for r in result.movie.collect()}
    assert movies[1]["title"] == "American President, The" and movies[1]["year"] == 1995
    assert movies[2]["title"] == 'Foo "Bar"' and movies[2]["genres"] is None and movies[2]["tmdbId"] == "77"
    assert (float(movies[1]["avgRating"]), movies[1]["ratingCount"]) == (2.25, 2)
    assert {r["mlUserId"] for r in result.user.collect()} == {10, 11, 12}
    assert result.rating.count() == 3
    assert result.rejected_movies.count() == 1 and result.rejected_ratings.count() == 2
    assert [r["movieId"] for r in result.unmapped_ratings.collect()] == [9]
    again = import_files(read_movielens(spark, folder), result.user, result.movie, result.rating, now)
    for name in ("user", "movie", "rating"):
        one, two = getattr(result, name), getattr(again, name)
        assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)
