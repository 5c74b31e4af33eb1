"""Queries on movies: staging, pages, search, similar movies, feeds and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill import schemas
from tastemill.functions import numbers, text, times
from tastemill.functions.documents import flatten_items
from tastemill.operators import aggregates, feeds, filters, integrity, joins, pages, ranking, upsert
from tastemill.operators.similar import similar_items
from tastemill.plans.importer import import_files
from tastemill.plans.registry import plain, query
from tastemill.plans.sql import (
    ITEM,
    LOADED,
    MOVIE,
    MOVIE_STATS,
    NOW,
    RATED_MOVIE,
    RATING_LOG,
    to_fixed_one,
)
from tastemill.session import enable_checkpoints, work_dir
from tastemill.sources import files, warehouse

CARD_SQL = "id, title, genres, year, posterUrl, avgRating, ratingCount"


@query("movie_stats", f"WITH {RATING_LOG}, {MOVIE_STATS} SELECT * FROM movie_stats")
def movie_stats(spark, folder):
    return plain(aggregates.movie_stats(warehouse.rating_log(spark, folder)))


@query("movie_stats_applied", f"WITH {RATED_MOVIE} SELECT id, title, source, avgRating, ratingCount FROM rated")
def movie_stats_applied(spark, folder):
    return plain(warehouse.rated_movie(spark, folder).select("id", "title", "source", "avgRating", "ratingCount"))


@query("top_movies", f"""WITH {RATED_MOVIE}
SELECT id, title, avgRating, ratingCount FROM rated WHERE ratingCount > 20
ORDER BY avgRating DESC, id LIMIT 10""")
def top_movies(spark, folder):
    return plain(ranking.top_movies(warehouse.rated_movie(spark, folder), 20, 10))


@query("movies_with_ratings", f"""WITH {RATED_MOVIE}
SELECT id, title, avgRating, ratingCount FROM rated WHERE ratingCount > 0
ORDER BY avgRating DESC, id LIMIT 5""")
def movies_with_ratings(spark, folder):
    return plain(ranking.top_movies(warehouse.rated_movie(spark, folder), 0, 5))


@query("catalogue_summary", f"""WITH {RATED_MOVIE}
SELECT source, count(*) AS movies, count(*) FILTER (ratingCount > 0) AS rated, CAST(sum(ratingCount) AS BIGINT) AS ratings,
       min(avgRating) FILTER (ratingCount > 0) AS worst, max(avgRating) FILTER (ratingCount > 0) AS best,
       round(avg(avgRating) FILTER (ratingCount > 0), 6) AS mean,
       round(sum(avgRating * ratingCount) / nullif(sum(ratingCount), 0), 6) AS weighted
FROM rated GROUP BY source""")
def catalogue_summary(spark, folder):
    summary = aggregates.source_profile(warehouse.rated_movie(spark, folder))
    return summary.withColumns({"mean": F.round("mean", 6), "weighted": F.round("weighted", 6)})


@query("list_movies_after", f"""WITH {RATED_MOVIE}
SELECT id, title, avgRating FROM rated WHERE avgRating < 3 OR (avgRating = 3 AND id > 100) ORDER BY avgRating DESC, id LIMIT 20""")
def list_movies_after(spark, folder):
    return plain(ranking.page_after(warehouse.rated_movie(spark, folder), 3.0, 100).select("id", "title", "avgRating"))


@query("count_by_source", f"WITH {MOVIE} SELECT source, count(*) AS movies FROM movie GROUP BY source")
def count_by_source(spark, folder):
    return aggregates.count_by_source(warehouse.movie(spark, folder))


@query("movies_of_source", f"WITH {MOVIE} SELECT id, title, source FROM movie WHERE source = 'TMDB'")
def movies_of_source(spark, folder):
    return filters.by_source(warehouse.movie(spark, folder), "TMDB").select("id", "title", "source")


@query("movie_cards", f"WITH {RATED_MOVIE} SELECT {CARD_SQL} FROM rated")
def movie_cards(spark, folder):
    return plain(filters.select_movie_card(warehouse.rated_movie(spark, folder)))


@query("movie_by_id", f"WITH {MOVIE} SELECT id, title, genres, year FROM movie WHERE id = 42")
def movie_by_id(spark, folder):
    return filters.movie_by_id(warehouse.movie(spark, folder), 42).select("id", "title", "genres", "year")


@query("movie_detail", f"""WITH {RATED_MOVIE}
SELECT CAST(id AS VARCHAR) AS id, title, originalTitle, genres, year, director, actors, description, posterUrl,
       CAST(mlMovieId AS VARCHAR) AS mlMovieId, imdbId, tmdbId, source, avgRating, ratingCount,
       created_at, updated_at
FROM rated""")
def movie_detail(spark, folder):
    detail = filters.select_movie_detail(warehouse.rated_movie(spark, folder))
    return plain(filters.present(detail, ids=("id", "mlMovieId")))


@query("present_movies", f"""WITH {RATED_MOVIE}
SELECT CAST(id AS VARCHAR) AS id, title, genres, year, posterUrl, avgRating, ratingCount FROM rated""")
def present_movies(spark, folder):
    return filters.present(filters.select_movie_card(warehouse.rated_movie(spark, folder)))


@query("average_label", f"""WITH {RATED_MOVIE}
SELECT id, CASE WHEN avgRating = 0 THEN '暂无' ELSE {to_fixed_one('avgRating')} END AS label FROM rated""")
def average_label(spark, folder):
    movie = warehouse.rated_movie(spark, folder)
    return movie.select("id", numbers.average_label(F.col("avgRating")).alias("label"))


@query("list_movies_page", f"""WITH {RATED_MOVIE}
SELECT {CARD_SQL} FROM rated ORDER BY avgRating DESC NULLS LAST, id LIMIT 20 OFFSET 20""")
def list_movies_page(spark, folder):
    return plain(ranking.list_movies(warehouse.rated_movie(spark, folder), page=2))


@query("list_movies_by_year", f"""WITH {RATED_MOVIE}
SELECT {CARD_SQL} FROM rated ORDER BY year DESC NULLS LAST, id LIMIT 20""")
def list_movies_by_year(spark, folder):
    return plain(ranking.list_movies(warehouse.rated_movie(spark, folder), sort="year"))


@query("list_movies_by_title", f"""WITH {RATED_MOVIE}
SELECT {CARD_SQL} FROM rated WHERE contains(strip_accents(lower(title)), 'red')
ORDER BY strip_accents(lower(title)) NULLS FIRST, id LIMIT 15 OFFSET 30""")
def list_movies_by_title(spark, folder):
    return plain(ranking.list_movies(
        warehouse.rated_movie(spark, folder), keyword="RED", sort="title", page=3, page_size=15))


@query("list_movies_filtered", f"""WITH {RATED_MOVIE}
SELECT {CARD_SQL} FROM rated WHERE list_contains(string_split(genres, '|'), 'PROMO') AND year = 1975
ORDER BY avgRating DESC NULLS LAST, id LIMIT 20""")
def list_movies_filtered(spark, folder):
    return plain(ranking.list_movies(warehouse.rated_movie(spark, folder), genre="PROMO", year=1975))


@query("search_titles", f"""WITH {MOVIE}
SELECT id, title FROM movie WHERE contains(strip_accents(lower(title)), 'red')""")
def search_titles(spark, folder):
    return filters.search_titles(warehouse.movie(spark, folder), "RÉD").select("id", "title")


@query("page_info", f"""WITH {MOVIE}
SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS totalPages
FROM movie WHERE contains(strip_accents(lower(title)), 'red')""")
def page_info(spark, folder):
    return ranking.page_info(filters.search_titles(warehouse.movie(spark, folder), "red"), 20)


@query("title_year", """
WITH named AS (
  SELECT p_partkey AS movieId,
         CASE WHEN p_size > 2 THEN p_name || ' (' || (1950 + p_size) || ')' ELSE p_name END AS raw
  FROM part)
SELECT movieId, trim(regexp_replace(trim(raw), '\\((\\d{4})\\)\\s*$', '')) AS title,
       TRY_CAST(nullif(regexp_extract(trim(raw), '\\((\\d{4})\\)\\s*$', 1), '') AS INTEGER) AS year
FROM named""")
def title_year(spark, folder):
    title, year = text.split_title_year(F.col("title"))
    return warehouse.raw_movies(spark, folder).select("movieId", title.alias("title"), year.alias("year"))


@query("clean_genres", """
SELECT p_partkey AS movieId, CASE WHEN p_size > 1 THEN p_type || '|' || p_brand END AS genres,
       CASE WHEN p_size > 1 THEN p_type END AS first
FROM part""")
def clean_genres(spark, folder):
    genres = text.clean_genres(F.col("genres"))
    return warehouse.raw_movies(spark, folder).select(
        "movieId", genres.alias("genres"), text.first_genre(genres).alias("first"))


@query("genre_explode", f"""WITH {MOVIE}
SELECT id, unnest(string_split(genres, '|')) AS genre FROM movie""")
def genre_explode(spark, folder):
    return warehouse.movie(spark, folder).select("id", F.explode(text.genre_list(F.col("genres"))).alias("genre"))


STAGED = """links AS (
  SELECT p_partkey AS movieId, 'tt' || p_partkey AS imdbId,
         nullif(trim(CASE WHEN p_size < 4 THEN '  ' ELSE 't' || p_partkey END), '') AS tmdbId
  FROM part WHERE p_size < 46),
staged AS (
  SELECT movie.mlMovieId, movie.title, movie.originalTitle, movie.genres, movie.year, links.imdbId, links.tmdbId,
         'ML' AS source
  FROM movie LEFT JOIN links ON links.movieId = movie.mlMovieId)"""


@query("stage_movies", f"WITH {MOVIE}, {STAGED} SELECT * FROM staged")
def stage_movies(spark, folder):
    return joins.stage_movies(warehouse.raw_movies(spark, folder), warehouse.raw_links(spark, folder))


@query("csv_catalogue", f"""WITH {MOVIE}, {STAGED}
SELECT staged.* REPLACE ('"' || movie.title || '", The' AS title,
       '"' || movie.title || '", The (' || (1950 + movie.p_size) || ')' AS originalTitle, 1950 + movie.p_size AS year)
FROM staged JOIN movie USING (mlMovieId)""")
def csv_catalogue(spark, folder):
    """Both catalogue files written as CSV with quotes and commas in the titles, and read back."""
    base = work_dir(spark, "csv")
    quoted = F.concat(F.lit('"'), "p_name", F.lit('", The ('), (F.col("p_size") + 1950).cast("string"), F.lit(")"))
    titles = warehouse.table(spark, folder, "part").select(F.col("p_partkey").alias("movieId"), quoted.alias("title"))
    movies = warehouse.raw_movies(spark, folder).drop("title").join(titles, "movieId").select(
        "movieId", "title", "genres")
    ratings = warehouse.rating_log(spark, folder).select("userId", "movieId", "rating", "timestamp")
    for name, df in (("movies", movies), ("links", warehouse.raw_links(spark, folder)), ("ratings", ratings)):
        df.write.csv(f"{base}/{name}.csv", header=True, quote='"', escape='"')
    read = files.read_movielens(spark, base)
    parsed, _ = filters.parse_or_reject(read["movies"], {"movieId": "bigint"})
    links, _ = filters.parse_or_reject(read["links"], {"movieId": "bigint"})
    return joins.stage_movies(parsed, links)


@query("malformed_lines", f"""WITH {RATING_LOG}, lines AS (
  SELECT seq, userId || ',' || movieId || ',' || rating AS line, timestamp FROM rating_log)
SELECT 'ratings' AS file, CASE seq % 10 WHEN 7 THEN line ELSE line || ',' || timestamp || ',' || seq END AS line
FROM lines WHERE seq % 10 IN (6, 7)""")
def malformed_lines(spark, folder):
    """Lines of the rating file with a field too few or too many, as they are; all others are read."""
    base = work_dir(spark, "lines")
    log = warehouse.rating_log(spark, folder)
    turn = F.col("seq") % 10
    line = F.concat_ws(",", "userId", "movieId", F.col("rating").cast("string"), F.when(turn != 7, F.col("timestamp")),
                       F.when(turn == 6, F.col("seq")))
    # Lines are written as they are: one column named like the header, with a separator that no line has.
    log.select(line.alias("userId,movieId,rating,timestamp")).write.csv(f"{base}/ratings.csv", header=True, sep="\u0001")
    read = {"ratings": files.read_csv(spark, f"{base}/ratings.csv", schemas.RATINGS_CSV, malformed=True)}
    clean, lines = files.split_malformed(read)
    if clean["ratings"].count() + lines.count() != log.count():
        raise AssertionError("a line was lost")
    return lines


def one_page(spark, df, order, page, size):
    """A page by the directory of a list stored in this order."""
    path = work_dir(spark, "pages")
    pages.store_pages(df, order, path)
    return pages.read_page(spark, path, page, size)


@query("deep_pages", f"""WITH {RATED_MOVIE}, sorted AS (
  SELECT 'avgRating' AS list, id, row_number() OVER (ORDER BY avgRating DESC NULLS LAST, id) - 1 AS position FROM rated
  UNION ALL SELECT 'year', id, row_number() OVER (ORDER BY year DESC NULLS LAST, id) - 1 FROM rated
  UNION ALL SELECT 'title', id, row_number() OVER (ORDER BY strip_accents(lower(title)) NULLS FIRST, id) - 1 FROM rated)
SELECT * FROM sorted WHERE position BETWEEN 160 AND 179""")
def deep_pages(spark, folder):
    """Page 9 of the catalogue in each of its orders."""
    movies = warehouse.rated_movie(spark, folder)
    return reduce(DataFrame.unionByName, [
        one_page(spark, movies, ranking.movie_order(sort), 9, 20).select(F.lit(sort).alias("list"), "id", "position")
        for sort in ("avgRating", "year", "title")])


FIRST_LOAD = f"""{RATING_LOG},
lines AS (SELECT *, CASE WHEN seq % 10 = 7 THEN NULL ELSE rating END AS given FROM rating_log),
rating AS (
  SELECT * FROM lines WHERE given IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY userId, movieId ORDER BY timestamp DESC, given DESC) = 1)"""


@query("first_load", f"""WITH {FIRST_LOAD}
SELECT 'user' AS part, count(DISTINCT userId) AS n, CAST(sum(DISTINCT userId) AS BIGINT) AS total FROM lines
UNION ALL SELECT 'movie', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part
UNION ALL SELECT 'title', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part WHERE p_size % 2 = 0
UNION ALL SELECT 'link', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part WHERE p_size < 46 AND p_size % 3 = 0
UNION ALL SELECT 'rating', count(*), CAST(sum(CAST(given * 10 AS BIGINT)) AS BIGINT) FROM rating
UNION ALL SELECT 'counted', count(DISTINCT movieId), count(*) FROM rating
UNION ALL SELECT 'rejected', count(*), CAST(sum(userId) AS BIGINT) FROM lines WHERE given IS NULL
UNION ALL SELECT 'unmapped', CAST(0 AS BIGINT), CAST(0 AS BIGINT)""")
def first_load(spark, folder):
    """All three files written and loaded into empty tables. Movies of even size and links of every third size come in
    two lines, of which the later has the smaller text and counts; one line of seven has no usable rating."""
    base = work_dir(spark, "load")
    part = warehouse.table(spark, folder, "part").select(F.col("p_partkey").alias("movieId"), "p_size")

    def twice(df, often, columns):
        both = df.join(part, "movieId").withColumn("turn", F.explode(F.when(often, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(1)))))
        later = {name: F.when((F.col("turn") == 1) & often, F.concat(F.lit("!"), name)).otherwise(F.col(name)) for name in columns}
        # Both lines of an id are in one file, the second after the first.
        return both.withColumns(later).repartitionByRange("movieId").sortWithinPartitions("movieId", "turn").drop("turn", "p_size")

    ratings = warehouse.rating_log(spark, folder).select(
        "userId", "movieId", F.when(F.col("seq") % 10 == 7, "none").otherwise(F.col("rating").cast("string")).alias("rating"),
        "timestamp", "seq")
    written = {"movies": twice(warehouse.raw_movies(spark, folder), F.col("p_size") % 2 == 0, ["title"]),
               "links": twice(warehouse.raw_links(spark, folder), F.col("p_size") % 3 == 0, ["imdbId"]),
               "ratings": ratings.drop("seq")}
    for name, df in written.items():
        df.write.csv(f"{base}/{name}.csv", header=True, quote='"', escape='"')
    tables = [spark.createDataFrame([], schema) for schema in (schemas.USER, schemas.MOVIE, schemas.RATING)]
    loaded = import_files(files.read_movielens(spark, base), *tables, now=warehouse.moment(warehouse.NOW))

    def summary(df, part, total):
        return df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias("total"))

    movie = loaded.movie
    return reduce(DataFrame.unionByName, [
        summary(loaded.user, "user", F.col("mlUserId")), summary(movie, "movie", F.col("mlMovieId")),
        summary(movie.where("startswith(title, '!')"), "title", F.col("mlMovieId")),
        summary(movie.where("startswith(imdbId, '!')"), "link", F.col("mlMovieId")),
        summary(loaded.rating, "rating", F.col("rating") * 10),
        summary(movie.where("ratingCount > 0"), "counted", F.col("ratingCount")),
        summary(loaded.rejected_ratings, "rejected", F.col("userId").cast("bigint")),
        summary(loaded.unmapped_ratings, "unmapped", F.lit(0))])


@query("upsert_catalogue", f"""WITH {MOVIE}, {STAGED},
t AS (SELECT * FROM movie WHERE p_size <= 40),
fresh AS (
  SELECT s.*, (SELECT max(id) FROM t) + row_number() OVER (ORDER BY s.mlMovieId) AS id
  FROM staged s ANTI JOIN t ON s.mlMovieId = t.mlMovieId)
SELECT t.id, s.title, t.originalTitle, s.genres, s.year, t.mlMovieId, s.imdbId, s.tmdbId, t.source,
       0.0 :: DOUBLE AS avgRating, 0 AS ratingCount, CAST({LOADED} AS BIGINT) AS created_at,
       CAST(CASE WHEN s.tmdbId IS DISTINCT FROM t.tmdbId OR s.genres IS DISTINCT FROM t.genres
                   OR s.imdbId IS DISTINCT FROM t.imdbId OR s.year IS DISTINCT FROM t.year
            THEN {NOW} ELSE {LOADED} END AS BIGINT) AS updated_at
FROM t JOIN staged s USING (mlMovieId)
UNION ALL
SELECT id, title, originalTitle, genres, year, mlMovieId, imdbId, tmdbId, source, 0.0, 0, {NOW}, {NOW} FROM fresh""")
def upsert_catalogue(spark, folder):
    known = warehouse.movie(spark, folder).join(
        warehouse.table(spark, folder, "part").where("p_size <= 40").select(F.col("p_partkey").alias("id")),
        "id", "left_semi").select(schemas.MOVIE.names)
    staged = joins.stage_movies(warehouse.raw_movies(spark, folder), warehouse.raw_links(spark, folder))
    merged = upsert.upsert_catalogue(known, staged, warehouse.moment(warehouse.NOW))
    return plain(merged.drop("director", "actors", "description", "posterUrl"))


@query("upsert_seeds", f"""WITH {MOVIE},
seeds(id, title, year) AS (VALUES
  (1, '肖申克的救赎', 1994), (2, '霸王别姬', 1993), (3, '这个杀手不太冷', 1994), (4, '阿甘正传', 1994),
  (5, '盗梦空间', 2010), (6, '星际穿越', 2014), (7, '楚门的世界', 1998), (8, '海上钢琴师', 1998),
  (9, '三傻大闹宝莱坞', 2009), (10, '放牛班的春天', 2004))
SELECT COALESCE(movie.id, seeds.id) AS id, COALESCE(seeds.title, movie.title) AS title,
       CASE WHEN movie.id IS NOT NULL THEN movie.year ELSE seeds.year END AS year
FROM movie FULL JOIN seeds ON seeds.id = movie.id""")
def upsert_seeds(spark, folder):
    return upsert.upsert_seeds(warehouse.movie(spark, folder), files.seed_movies(spark)).select("id", "title", "year")


@query("similar_items", f"""WITH {RATED_MOVIE},
base AS (SELECT id AS baseId, title AS baseTitle, string_split(genres, '|')[1] AS first FROM rated),
own AS (
  SELECT baseId, baseTitle, other.*,
         row_number() OVER (PARTITION BY baseId ORDER BY other.avgRating DESC NULLS LAST, other.id) AS place
  FROM base JOIN rated other
    ON other.id <> baseId AND contains(strip_accents(lower(other.genres)), strip_accents(lower(base.first)))
  QUALIFY place <= 10),
best AS (SELECT * FROM rated ORDER BY avgRating DESC NULLS LAST, id LIMIT 11),
overall AS (
  SELECT baseId, baseTitle, best.*, row_number() OVER (PARTITION BY baseId ORDER BY avgRating DESC, id) AS place
  FROM base ANTI JOIN own USING (baseId) JOIN best ON best.id <> baseId
  QUALIFY place <= 10)
SELECT baseId, baseTitle, CAST(place AS INTEGER) AS place, id, title, genres, year, posterUrl, description, avgRating
FROM (SELECT * FROM own UNION ALL BY NAME SELECT * FROM overall)""")
def similar(spark, folder):
    enable_checkpoints(spark)
    movie = warehouse.rated_movie(spark, folder).checkpoint()  # read four times, counted once
    return plain(similar_items(movie, 10))


@query("flatten_items", f"WITH {ITEM} SELECT * FROM item")
def flatten(spark, folder):
    return flatten_items(warehouse.item_documents(warehouse.table(spark, folder, "part")))


@query("item_json", f"WITH {ITEM} SELECT * FROM item")
def item_json(spark, folder):
    """Documents landed as JSON lines and read back."""
    base = work_dir(spark, "items")
    warehouse.item_documents(warehouse.table(spark, folder, "part")).write.json(base)
    return flatten_items(files.read_item_json(spark, base))


@query("rescale_vote", """
SELECT p_partkey AS id, CAST(printf('%.2f', p_retailprice / 250 / 2) AS DOUBLE) AS stars FROM part""")
def rescale_vote(spark, folder):
    return warehouse.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), numbers.rescale_vote(F.col("p_retailprice") / 250).alias("stars"))


FEEDS = """feed AS (
  SELECT p_partkey AS id, p_name AS title,
         CASE WHEN p_size <= 20 THEN 'popular' WHEN p_retailprice >= 1000 THEN 'top_rated' ELSE 'now_playing' END AS feed,
         p_size
  FROM part WHERE p_size <= 20 OR p_retailprice >= 1000 OR p_size >= 40)"""


@query("merge_feeds", f"WITH {FEEDS} SELECT id, title, feed FROM feed")
def merge_feeds(spark, folder):
    return feeds.merge_feeds(warehouse.feeds(spark, folder))


@query("new_items", f"WITH {FEEDS} SELECT 't' || id AS id, title, feed FROM feed WHERE p_size >= 46")
def new_items(spark, folder):
    merged = feeds.merge_feeds(warehouse.feeds(spark, folder)).withColumn("id", F.concat(F.lit("t"), "id"))
    return feeds.new_items(merged, warehouse.movie(spark, folder))


METADATA = f"""{MOVIE}, {ITEM},
incoming AS (SELECT item.* REPLACE ('t' || tmdbId AS tmdbId), CAST(tmdbId AS BIGINT) AS part FROM item),
fresh AS (
  SELECT i.tmdbId, (SELECT max(id) FROM movie) + row_number() OVER (ORDER BY i.tmdbId) AS id
  FROM incoming i WHERE i.tmdbId NOT IN (SELECT tmdbId FROM movie WHERE tmdbId IS NOT NULL)),
merged AS (
  SELECT movie.id, COALESCE(movie.tmdbId, i.tmdbId) AS tmdbId,
         CASE WHEN i.tmdbId IS NULL THEN movie.title ELSE i.title END AS title,
         CASE WHEN i.tmdbId IS NULL THEN movie.originalTitle ELSE i.originalTitle END AS originalTitle,
         CASE WHEN i.tmdbId IS NULL THEN movie.genres ELSE i.genres END AS genres,
         CASE WHEN i.tmdbId IS NULL THEN movie.year ELSE i.year END AS year,
         CASE WHEN i.tmdbId IS NULL THEN movie.director ELSE i.director END AS director,
         CASE WHEN i.tmdbId IS NULL THEN movie.actors ELSE i.actors END AS actors,
         CASE WHEN i.tmdbId IS NULL THEN movie.description ELSE i.description END AS description,
         CASE WHEN i.tmdbId IS NULL THEN movie.posterUrl ELSE i.posterUrl END AS posterUrl,
         movie.mlMovieId, movie.imdbId, COALESCE(movie.source, 'TMDB') AS source,
         COALESCE(i.avgRating, 0.0) AS avgRating, COALESCE(i.ratingCount, 0) AS ratingCount,
         CAST(CASE WHEN movie.id IS NULL THEN {NOW} ELSE {LOADED} END AS BIGINT) AS created_at,
         CAST(CASE WHEN i.tmdbId IS NULL THEN {LOADED} ELSE {NOW} END AS BIGINT) AS updated_at
  FROM movie FULL JOIN incoming i ON i.tmdbId = movie.tmdbId)"""

METADATA_SQL = f"""WITH {METADATA}
SELECT merged.* REPLACE (COALESCE(merged.id, fresh.id) AS id) FROM merged LEFT JOIN fresh ON fresh.tmdbId = merged.tmdbId"""


@query("upsert_metadata", METADATA_SQL)
def upsert_metadata(spark, folder):
    items = flatten_items(warehouse.item_documents(warehouse.table(spark, folder, "part")))
    batch = items.withColumn("tmdbId", F.concat(F.lit("t"), "tmdbId"))
    return plain(upsert.upsert_metadata(warehouse.movie(spark, folder), batch, warehouse.moment(warehouse.NOW)))


@query("require_non_null", f"""WITH {MOVIE}
SELECT id, tmdbId, tmdbId IS NOT NULL AND year IS NOT NULL AS accepted FROM movie""")
def require_non_null(spark, folder):
    good, bad = filters.require(warehouse.movie(spark, folder), ["tmdbId", "year"])
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False))).select(
        "id", "tmdbId", "accepted")


@query("with_defaults", f"""WITH {MOVIE}
SELECT id, COALESCE(genres, 'none') AS genres, COALESCE(year, 0) AS year FROM movie""")
def with_defaults(spark, folder):
    return filters.with_defaults(warehouse.movie(spark, folder).select("id", "genres", "year"),
                                 {"genres": "none", "year": 0})


@query("duplicate_titles", f"WITH {MOVIE} SELECT title, year, count(*) AS copies FROM movie "
       "WHERE year IS NOT NULL GROUP BY title, year HAVING count(*) > 1")
def duplicate_titles(spark, folder):
    return integrity.duplicate_keys(warehouse.movie(spark, folder), ["title", "year"])


@query("release_year", """
SELECT p_partkey AS id, CASE WHEN p_size > 4 THEN 1950 + p_size END AS year FROM part""")
def release_year(spark, folder):
    docs = warehouse.item_documents(warehouse.table(spark, folder, "part"))
    return docs.select("id", times.release_year(F.col("release_date")).alias("year"))
