"""Queries on ratings, users and recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill import schemas
from tastemill.functions import numbers, times
from tastemill.operators import aggregates, als, filters, integrity, joins, pages, ranking, upsert
from tastemill.session import work_dir
from tastemill.plans.registry import plain, query
from tastemill.plans.sql import (
    CUTOFF,
    EVENT,
    LOADED,
    MOVIE,
    NOW,
    RATED_MOVIE,
    RATING,
    RATING_LOG,
    RECS,
    SCORED,
    USER,
    latest,
    ranked,
    stats,
    to_fixed_one,
)
from tastemill.schemas import conform
from tastemill.sources import warehouse

RATINGS = f"{RATING_LOG}, {RATING}"
KNOWN_MOVIES = "known AS (SELECT p_partkey AS id FROM part WHERE p_size > 2)"


def known_movies(spark, folder):
    """The movies a rating may point to in the checks: all but those of the smallest parts."""
    part = warehouse.table(spark, folder, "part").where("p_size > 2")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("mlMovieId"))


def typed_ratings(df):
    """A rating log as the rating table, created and updated when it was given."""
    moment = F.timestamp_seconds("timestamp")
    return conform(df.withColumns({"created_at": moment, "updated_at": moment}), schemas.RATING)


@query("dataset_profile", f"""WITH {RATING_LOG}
SELECT count(*) AS ratings, count(DISTINCT userId) AS users, count(DISTINCT movieId) AS movies FROM rating_log""")
def dataset_profile(spark, folder):
    return aggregates.dataset_profile(warehouse.rating_log(spark, folder))


@query("sketched_profile", f"""WITH {RATING_LOG}
SELECT CAST(year(make_timestamp(timestamp * 1000000)) AS INTEGER) AS span, count(*) AS ratings, TRUE AS users, TRUE AS movies
FROM rating_log GROUP BY 1""")
def sketched_profile(spark, folder):
    """Users and movies of every year estimated from the sketches of its days: within 3 % of the exact counts."""
    log = warehouse.rating_log(spark, folder)
    years = aggregates.united_profile(aggregates.daily_sketches(log), F.year("day"))
    exact = log.groupBy(F.year(F.timestamp_seconds("timestamp")).alias("span")).agg(
        F.count_distinct("userId").alias("all_users"), F.count_distinct("movieId").alias("all_movies"))

    def near(name):
        return (F.abs(F.col(name) - F.col(f"all_{name}")) <= 0.03 * F.col(f"all_{name}") + 0.5).alias(name)

    return years.join(exact, "span").select("span", "ratings", near("users"), near("movies"))


@query("ratings_page_1000", f"""WITH {RATINGS}
SELECT userId, movieId, timestamp, position FROM (
  SELECT *, row_number() OVER (ORDER BY timestamp DESC, movieId, userId) - 1 AS position FROM rating)
WHERE position BETWEEN 4995 AND 4999""")
def ratings_page_1000(spark, folder):
    """Page 1000 of all ratings, the newest first, in pages of 5."""
    path = work_dir(spark, "pages")
    newest = [F.col("timestamp").desc_nulls_last(), F.col("movieId"), F.col("userId")]
    pages.store_pages(warehouse.rating(spark, folder).select("userId", "movieId", "timestamp"), newest, path)
    return pages.read_page(spark, path, 1000, 5)


@query("sample_users", f"WITH {RATING_LOG} SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating "
       "FROM rating_log WHERE userId <= 1000")
def sample_users(spark, folder):
    """The operator keeps the users with the lowest ids; here the bound falls inside the test data."""
    return plain(filters.sample_users(warehouse.rating_log(spark, folder), 1000).select("userId", "movieId", "rating"))


@query("training_cutoff", f"""WITH {RATING_LOG}
SELECT userId, movieId, timestamp, 'before-2000' AS version FROM rating_log WHERE timestamp < {CUTOFF}""")
def training_cutoff(spark, folder):
    cut = filters.before_cutoff(warehouse.rating_log(spark, folder), CUTOFF, "before-2000")
    return cut.select("userId", "movieId", "timestamp", "version")


@query("training_frame", f"""WITH {RATINGS}
SELECT CAST(userId AS INTEGER) AS "user", CAST(movieId AS INTEGER) AS item, CAST(rating AS FLOAT) AS label
FROM rating""")
def frame(spark, folder):
    return als.training_frame(warehouse.rating(spark, folder))


@query("rating_table", f"""WITH {RATINGS}
SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating, timestamp, timestamp AS created_at, timestamp AS updated_at
FROM rating""")
def rating_table(spark, folder):
    return plain(warehouse.rating(spark, folder))


@query("upsert_ratings", f"""WITH {RATING_LOG}, {latest('t', 'rating_log', f'timestamp < {CUTOFF}')},
{latest('u', 'rating_log', f'timestamp >= {CUTOFF}')}
SELECT COALESCE(t.userId, u.userId) AS userId, COALESCE(t.movieId, u.movieId) AS movieId,
       CAST(COALESCE(u.rating, t.rating) AS DOUBLE) AS rating, COALESCE(u.timestamp, t.timestamp) AS timestamp,
       COALESCE(t.timestamp, {NOW}) AS created_at,
       CASE WHEN u.userId IS NULL THEN t.timestamp ELSE {NOW} END AS updated_at
FROM t FULL JOIN u ON t.userId = u.userId AND t.movieId = u.movieId""")
def upsert_ratings(spark, folder):
    log = warehouse.rating_log(spark, folder).withColumn("seq", F.col("seq").cast("decimal(14,0)"))
    early, late = log.where(F.col("timestamp") < CUTOFF), log.where(F.col("timestamp") >= CUTOFF)
    known = typed_ratings(upsert.latest_per_key(early, upsert.RATING_KEY, ["timestamp", "seq"]))
    return plain(upsert.upsert_ratings(known, late, warehouse.moment(warehouse.NOW), order_by=["timestamp", "seq"]))


@query("upsert_users", f"""WITH {USER}, {RATING_LOG},
t AS (SELECT * FROM users WHERE c_acctbal >= 0),
fresh AS (
  SELECT userId AS mlUserId, (SELECT max(id) FROM t) + row_number() OVER (ORDER BY userId) AS id
  FROM (SELECT DISTINCT userId FROM rating_log) WHERE userId NOT IN (SELECT id FROM t))
SELECT id, userName, userAccount, id AS mlUserId, 'ML' AS source, CAST({LOADED} AS BIGINT) AS created_at FROM t
UNION ALL
SELECT id, 'MovieLens User ' || mlUserId, 'ml_user_' || mlUserId, mlUserId, 'ML', {NOW} FROM fresh""")
def upsert_users(spark, folder):
    rich = warehouse.table(spark, folder, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    known = warehouse.user(spark, folder)
    known = known.join(rich, "id", "left_semi").select(known.columns)
    ids = aggregates.distinct_user_ids(warehouse.rating_log(spark, folder)).withColumnRenamed("userId", "mlUserId")
    merged = upsert.upsert_users(known, upsert.stage_users(ids), warehouse.moment(warehouse.NOW))
    return plain(merged.select("id", "userName", "userAccount", "mlUserId", "source", "created_at"))


@query("stage_users", f"""WITH {RATING_LOG}
SELECT DISTINCT userId AS mlUserId, 'ml_user_' || userId AS userAccount, 'MovieLens User ' || userId AS userName,
       'ML' AS source FROM rating_log""")
def stage_users(spark, folder):
    ids = aggregates.distinct_user_ids(warehouse.rating_log(spark, folder))
    return upsert.stage_users(ids, "userId")


TEXTS = """texts AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'x' || user_id ELSE CAST(user_id AS VARCHAR) END AS userId,
         CAST(json_extract(props, '$.k') AS VARCHAR) AS movieId,
         CASE WHEN event_type = 'signup' THEN '' ELSE CAST(value AS VARCHAR) END AS rating
  FROM events)"""


def rating_texts(spark, folder):
    """Ratings as text the way a file holds them; some users and some ratings do not parse."""
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    return warehouse.table(spark, folder, "events").select(
        "event_id",
        F.when(kind == "error", F.concat(F.lit("x"), user)).otherwise(user).alias("userId"),
        F.get_json_object("props", "$.k").alias("movieId"),
        F.when(kind == "signup", "").otherwise(F.col("value").cast("string")).alias("rating"),
    )


PARSED = {"userId": "bigint", "movieId": "bigint", "rating": "double"}


@query("parse_or_reject", f"""WITH {TEXTS}
SELECT event_id, TRY_CAST(userId AS BIGINT) AS userId, TRY_CAST(movieId AS BIGINT) AS movieId,
       TRY_CAST(rating AS DOUBLE) AS rating FROM texts
WHERE TRY_CAST(userId AS BIGINT) IS NOT NULL AND TRY_CAST(movieId AS BIGINT) IS NOT NULL
  AND TRY_CAST(rating AS DOUBLE) IS NOT NULL""")
def parse_or_reject(spark, folder):
    return filters.parse_or_reject(rating_texts(spark, folder), PARSED)[0]


@query("parse_rejects", f"""WITH {TEXTS}
SELECT event_id, userId, movieId FROM texts
WHERE TRY_CAST(userId AS BIGINT) IS NULL OR TRY_CAST(rating AS DOUBLE) IS NULL""")
def parse_rejects(spark, folder):
    return filters.parse_or_reject(rating_texts(spark, folder), PARSED)[1].select("event_id", "userId", "movieId")


@query("ingest_summary", """
SELECT count(*) AS total, count(CASE WHEN event_type NOT IN ('error', 'signup') THEN 1 END) AS imported,
       count(CASE WHEN event_type IN ('error', 'signup') THEN 1 END) AS skipped FROM events""")
def ingest_summary(spark, folder):
    """The counts an import reports, observed while one action runs over the rows."""
    parsed = [F.col(name).try_cast(kind).isNull() for name, kind in PARSED.items()]
    bad = parsed[0] | parsed[1] | parsed[2]
    watched, metrics = aggregates.with_metrics(rating_texts(spark, folder), "import", imported=~bad, skipped=bad)
    watched.write.format("noop").mode("overwrite").save()
    seen = metrics.get
    return spark.createDataFrame([(seen["rows"], seen["imported"], seen["skipped"])],
                                 "total bigint, imported bigint, skipped bigint")


@query("distinct_user_ids", f"""WITH {TEXTS}
SELECT DISTINCT TRY_CAST(userId AS BIGINT) AS userId FROM texts WHERE TRY_CAST(userId AS BIGINT) IS NOT NULL""")
def distinct_user_ids(spark, folder):
    return aggregates.distinct_user_ids(rating_texts(spark, folder))


INTERNAL = f"""{RATING_LOG}, {KNOWN_MOVIES},
u AS (SELECT c_custkey AS mlUserId, c_custkey + 1000000 AS id FROM customer WHERE c_acctbal >= 0)"""


def internal_users(spark, folder):
    return warehouse.table(spark, folder, "customer").where("c_acctbal >= 0").select(
        F.col("c_custkey").alias("mlUserId"), (F.col("c_custkey") + 1000000).alias("id"))


@query("resolve_ids", f"""WITH {INTERNAL}
SELECT u.id AS userId, known.id AS movieId, CAST(rating AS DOUBLE) AS rating, timestamp, seq
FROM rating_log JOIN u ON u.mlUserId = rating_log.userId JOIN known ON known.id = rating_log.movieId""")
def resolve_ids(spark, folder):
    return plain(joins.resolve_ids(
        warehouse.rating_log(spark, folder), internal_users(spark, folder), known_movies(spark, folder)))


@query("unmapped_ratings", f"""WITH {INTERNAL}
SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating, timestamp, seq FROM rating_log
WHERE userId NOT IN (SELECT mlUserId FROM u) OR movieId NOT IN (SELECT id FROM known)""")
def unmapped_ratings(spark, folder):
    return plain(joins.unmapped(
        warehouse.rating_log(spark, folder), internal_users(spark, folder), known_movies(spark, folder)))


@query("resolve_stream_ids", f"""WITH {EVENT}, {MOVIE}
SELECT event.userId, 't' || event.movieId AS tmdbId, event.rating, movie.id AS movieId
FROM event JOIN movie ON movie.tmdbId = 't' || event.movieId""")
def resolve_stream_ids(spark, folder):
    events = warehouse.rating_events(warehouse.table(spark, folder, "events"))
    named = events.select("userId", F.concat(F.lit("t"), "movieId").alias("tmdbId"), "rating")
    return joins.resolve_stream_ids(named, warehouse.movie(spark, folder)).select(
        "userId", "tmdbId", "rating", "movieId")


@query("validate_ratings", f"""WITH {KNOWN_MOVIES}
SELECT l_orderkey, l_linenumber, l_partkey AS movieId, l_quantity / 9 AS rating,
       CASE WHEN l_quantity / 9 < 1.0 OR l_quantity / 9 > 5.0 THEN 'out of range'
            WHEN l_partkey NOT IN (SELECT id FROM known) THEN 'unknown movie' END AS reason
FROM lineitem""")
def validate_ratings(spark, folder):
    given = warehouse.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("movieId"), (F.col("l_quantity") / 9).alias("rating"))
    return filters.check_ratings(given, known_movies(spark, folder))


@query("orphans", f"""WITH {RATINGS}, {KNOWN_MOVIES}
SELECT userId, movieId, timestamp FROM rating WHERE movieId NOT IN (SELECT id FROM known)""")
def orphans(spark, folder):
    found = integrity.orphans(warehouse.rating(spark, folder), known_movies(spark, folder), "movieId")
    return found.select("userId", "movieId", "timestamp")


@query("orphans_of_all_keys", f"""WITH {RECS}, {KNOWN_MOVIES}, known_users AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey > 1)
SELECT 'rating.userId' AS key, count(*) AS rows FROM rating WHERE userId NOT IN (SELECT id FROM known_users)
UNION ALL SELECT 'rating.movieId', count(*) FROM rating WHERE movieId NOT IN (SELECT id FROM known)
UNION ALL SELECT 'recommendation.userId', count(*) FROM recs WHERE userId NOT IN (SELECT id FROM known_users)
UNION ALL SELECT 'recommendation.movieId', count(*) FROM recs WHERE movieId NOT IN (SELECT id FROM known)""")
def orphans_of_all_keys(spark, folder):
    """Rows that each of the four references leaves without a parent."""
    users = warehouse.table(spark, folder, "customer").where("c_nationkey > 1").select(F.col("c_custkey").alias("id"))
    parents = {"userId": users, "movieId": known_movies(spark, folder)}
    children = {"rating": warehouse.rating(spark, folder), "recommendation": warehouse.recommendation(spark, folder)}
    counts = [integrity.orphans(child, parent, fk).agg(F.lit(f"{name}.{fk}").alias("key"), F.count(F.lit(1)).alias("rows"))
              for name, child in children.items() for fk, parent in parents.items()]
    return reduce(DataFrame.unionByName, counts)


@query("duplicate_keys", f"""WITH {RATING_LOG}
SELECT userId, movieId, count(*) AS copies FROM rating_log GROUP BY userId, movieId HAVING count(*) > 1""")
def duplicate_keys(spark, folder):
    return integrity.duplicate_keys(warehouse.rating_log(spark, folder), ["userId", "movieId"])


@query("cascade_delete", f"""WITH {RECS}, gone AS (SELECT p_partkey AS id FROM part WHERE p_size <= 2)
SELECT 'rating' AS child, userId, movieId FROM rating WHERE movieId NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'recommendation', userId, movieId FROM recs WHERE movieId NOT IN (SELECT id FROM gone)""")
def cascade_delete(spark, folder):
    gone = warehouse.table(spark, folder, "part").where("p_size <= 2").select(F.col("p_partkey").alias("id"))
    children = {"rating": warehouse.rating(spark, folder), "recommendation": warehouse.recommendation(spark, folder)}
    kept = integrity.cascade_delete(gone, "movieId", *children.values())
    tagged = [df.select(F.lit(name).alias("child"), "userId", "movieId") for name, df in zip(children, kept)]
    return tagged[0].unionByName(tagged[1])


GONE_USERS = "gone AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey <= 1)"


def without_users(spark, folder):
    """Users, ratings, recommendations and movies when the users of the first two nations are deleted."""
    gone = warehouse.table(spark, folder, "customer").where("c_nationkey <= 1").select(F.col("c_custkey").alias("id"))
    rating = warehouse.rating(spark, folder)
    movie = upsert.apply_movie_stats(warehouse.movie(spark, folder), aggregates.movie_stats(rating))
    return integrity.delete_users(
        gone, warehouse.user(spark, folder), rating, warehouse.recommendation(spark, folder), movie, warehouse.moment(warehouse.NOW))


@query("delete_users", f"""WITH {RECS}, {GONE_USERS}
SELECT 'user' AS child, c_custkey AS userId, CAST(NULL AS BIGINT) AS movieId FROM customer WHERE c_custkey NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'rating', userId, movieId FROM rating WHERE userId NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'recommendation', userId, movieId FROM recs WHERE userId NOT IN (SELECT id FROM gone)""")
def delete_users(spark, folder):
    users, ratings, recs, _ = without_users(spark, folder)
    rows = [users.select(F.lit("user").alias("child"), F.col("id").alias("userId"), F.lit(None).cast("bigint").alias("movieId"))]
    rows += [df.select(F.lit(name).alias("child"), "userId", "movieId") for name, df in (("rating", ratings), ("recommendation", recs))]
    return reduce(DataFrame.unionByName, rows)


@query("delete_users_stats", f"""WITH {RATINGS}, {MOVIE}, {GONE_USERS},
kept AS (SELECT * FROM rating WHERE userId NOT IN (SELECT id FROM gone)), {stats('old_stats', 'rating')}, {stats('new_stats', 'kept')}
SELECT movie.id, COALESCE(n.avgRating, 0.0) AS avgRating, CAST(COALESCE(n.ratingCount, 0) AS INTEGER) AS ratingCount,
       CAST(CASE WHEN COALESCE(n.ratingCount, 0) < o.ratingCount THEN {NOW} ELSE {LOADED} END AS BIGINT) AS updated_at
FROM movie LEFT JOIN old_stats o ON o.movieId = movie.id LEFT JOIN new_stats n ON n.movieId = movie.id""")
def delete_users_stats(spark, folder):
    return plain(without_users(spark, folder)[3].select("id", "avgRating", "ratingCount", "updated_at"))


@query("ratings_for_user", f"""WITH {RATINGS}
SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating FROM rating WHERE userId = 7""")
def ratings_for_user(spark, folder):
    return plain(filters.ratings_for_user(warehouse.rating(spark, folder), 7).select("userId", "movieId", "rating"))


@query("ratings_for_movie", f"""WITH {RATINGS}
SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating FROM rating WHERE movieId = 11""")
def ratings_for_movie(spark, folder):
    return plain(filters.ratings_for_movie(warehouse.rating(spark, folder), 11).select("userId", "movieId", "rating"))


@query("latest_ratings", f"""WITH {RATINGS}
SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating, timestamp AS created_at FROM rating
ORDER BY timestamp DESC, userId, movieId LIMIT 10""")
def latest_ratings(spark, folder):
    return plain(ranking.latest_ratings(warehouse.rating(spark, folder)).select(
        "userId", "movieId", "rating", "created_at"))


USER_RATINGS = f"""{RATINGS}, {MOVIE},
view AS (
  SELECT r.userId, r.movieId, CAST(r.rating AS DOUBLE) AS rating, r.timestamp AS createdAt,
         CAST(movie.id AS VARCHAR) AS id, title, genres, year, posterUrl
  FROM rating r JOIN movie ON movie.id = r.movieId)"""


@query("user_ratings_view", f"WITH {USER_RATINGS} SELECT * FROM view")
def user_ratings_view(spark, folder):
    view = joins.user_ratings_view(warehouse.rating(spark, folder), warehouse.movie(spark, folder))
    return plain(view.select("*", "movie.*").drop("movie"))


@query("user_ratings_page", f"""WITH {USER_RATINGS}
SELECT * FROM view WHERE userId = 7 ORDER BY createdAt DESC, movieId LIMIT 10 OFFSET 10""")
def user_ratings_page(spark, folder):
    mine = filters.ratings_for_user(warehouse.rating(spark, folder), 7)
    view = joins.user_ratings_view(mine, warehouse.movie(spark, folder))
    return plain(ranking.paginate(view, ranking.newest_first(), 2, 10).select("*", "movie.*").drop("movie"))


@query("movie_ratings_view", f"""WITH {RATINGS}, {USER}
SELECT r.userId, r.movieId, CAST(r.rating AS DOUBLE) AS rating, r.timestamp AS createdAt,
       CAST(users.id AS VARCHAR) AS id, COALESCE(userName, '匿名用户') AS userName
FROM rating r JOIN users ON users.id = r.userId""")
def movie_ratings_view(spark, folder):
    view = joins.movie_ratings_view(warehouse.rating(spark, folder), warehouse.user(spark, folder))
    return plain(view.select("*", "user.*").drop("user"))


@query("movie_ratings_page", f"""WITH {RATINGS}, {USER}
SELECT r.userId, CAST(r.rating AS DOUBLE) AS rating, r.timestamp AS createdAt,
       COALESCE(userName, '匿名用户') AS userName
FROM rating r JOIN users ON users.id = r.userId WHERE r.movieId = 11
ORDER BY r.timestamp DESC, r.userId LIMIT 20""")
def movie_ratings_page(spark, folder):
    one = filters.ratings_for_movie(warehouse.rating(spark, folder), 11)
    view = joins.movie_ratings_view(one, warehouse.user(spark, folder))
    page = ranking.paginate(view, ranking.newest_first("userId"), 1, 20)
    return plain(page.select("userId", "rating", "createdAt", "user.userName"))


@query("show_dates", f"""WITH {RATINGS}
SELECT userId, movieId, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y/%-m/%-d') AS shown FROM rating""")
def show_dates(spark, folder):
    return warehouse.rating(spark, folder).select(
        "userId", "movieId", times.show_date(F.col("created_at")).alias("shown"))


@query("lookup_rating", f"""WITH {RATINGS}, {EVENT},
asked AS (SELECT DISTINCT userId, movieId FROM event)
SELECT asked.userId, asked.movieId, rating.rating IS NOT NULL AS rated,
       COALESCE(CAST(rating.rating AS DOUBLE), 0.0) AS rating
FROM asked LEFT JOIN rating ON rating.userId = asked.userId AND rating.movieId = asked.movieId""")
def lookup_rating(spark, folder):
    asked = warehouse.rating_events(warehouse.table(spark, folder, "events")).select("userId", "movieId").distinct()
    return joins.lookup_rating(asked, warehouse.rating(spark, folder))


@query("user_stats", f"""WITH {RECS}, {USER},
r AS (SELECT userId, count(*) AS n,
             CAST((20000 * 2 * sum(CAST(rating * 10 AS BIGINT)) + 2 * count(*)) // (4 * count(*)) AS DOUBLE) / 100000.0 AS mean
      FROM rating GROUP BY userId),
a AS (SELECT userId, count(*) AS n FROM recs GROUP BY userId)
SELECT users.id AS userId, COALESCE(r.n, 0) AS ratingsCount, COALESCE(a.n, 0) AS recommendationsCount,
       COALESCE({to_fixed_one('r.mean')}, '0.0') AS avgRating
FROM users LEFT JOIN r ON r.userId = users.id LEFT JOIN a ON a.userId = users.id""")
def user_stats(spark, folder):
    return aggregates.user_stats(
        warehouse.user(spark, folder), warehouse.rating(spark, folder), warehouse.recommendation(spark, folder))


@query("refresh_stats", f"""WITH {RATINGS}, {MOVIE},
early AS (SELECT * FROM rating_log WHERE timestamp < {CUTOFF}),
batch AS (SELECT DISTINCT movieId FROM rating_log WHERE timestamp >= {CUTOFF} AND rating >= 4.5),
{stats('old_stats', 'early')}, {stats('new_stats', 'rating')}
SELECT movie.id, COALESCE(CASE WHEN batch.movieId IS NOT NULL THEN n.avgRating ELSE o.avgRating END, 0.0) AS avgRating,
       CAST(COALESCE(CASE WHEN batch.movieId IS NOT NULL THEN n.ratingCount ELSE o.ratingCount END, 0) AS INTEGER)
         AS ratingCount
FROM movie LEFT JOIN batch ON batch.movieId = movie.id LEFT JOIN old_stats o ON o.movieId = movie.id
LEFT JOIN new_stats n ON n.movieId = movie.id""")
def refresh_stats(spark, folder):
    log = warehouse.rating_log(spark, folder)
    before = upsert.apply_movie_stats(
        warehouse.movie(spark, folder), aggregates.movie_stats(log.where(F.col("timestamp") < CUTOFF)))
    batch = log.where((F.col("timestamp") >= CUTOFF) & (F.col("rating") >= 4.5))
    after = aggregates.refresh_stats(warehouse.rating(spark, folder), before, batch)
    return plain(after.select("id", "avgRating", "ratingCount"))


@query("delta_stats", f"WITH {RATINGS}, {stats('s', 'rating')} SELECT * FROM s")
def delta_stats(spark, folder):
    """Statistics before a cutoff plus what later ratings changed: the statistics of the table now."""
    log = warehouse.rating_log(spark, folder)
    before = upsert.latest_per_key(log.where(F.col("timestamp") < CUTOFF), upsert.RATING_KEY, ["timestamp", "seq"])
    changes = upsert.changed_values(before, log.where(F.col("timestamp") >= CUTOFF), upsert.RATING_KEY, "rating", ["timestamp", "seq"])
    sums = aggregates.add_stats(aggregates.stat_sums(before), aggregates.change_deltas(changes))
    return plain(aggregates.finish_stats(sums))


@query("rank_recommendations", f"""WITH {RATINGS}, {SCORED}
SELECT userId, movieId, score, CAST(row_number() OVER (PARTITION BY userId ORDER BY score DESC, movieId) AS INTEGER) AS rank,
       'ALS' AS algorithm, CAST({NOW} AS BIGINT) AS created_at
FROM scored QUALIFY rank <= 20""")
def rank_recommendations(spark, folder):
    return plain(ranking.rank_recommendations(warehouse.scored(spark, folder), 20, now=warehouse.moment(warehouse.NOW)))


RUNS = f"""{RATINGS}, {SCORED}, {ranked('old', 'scored.score >= 5', 20)},
{ranked('fresh', 'scored.score >= 4', 10, NOW)}"""


def two_runs(spark, folder):
    """An earlier run that is stored, and a new one."""
    best = warehouse.scored(spark, folder).where(F.col("score") >= 4)
    fresh = ranking.rank_recommendations(best, 10, now=warehouse.moment(warehouse.NOW))
    old = warehouse.recommendation(spark, folder)
    return old, fresh


@query("upsert_recommendations", f"""WITH {RUNS}
SELECT COALESCE(f.userId, o.userId) AS userId, COALESCE(f.movieId, o.movieId) AS movieId,
       COALESCE(f.score, o.score) AS score, COALESCE(f.rank, o.rank) AS rank, 'ALS' AS algorithm,
       COALESCE(f.created_at, o.created_at) AS created_at
FROM old o FULL JOIN fresh f ON f.userId = o.userId AND f.movieId = o.movieId""")
def upsert_recommendations(spark, folder):
    return plain(upsert.upsert_recommendations(*two_runs(spark, folder), mode="merge", unique=True))


@query("replace_recommendations", f"WITH {RUNS} SELECT * FROM fresh")
def replace_recommendations(spark, folder):
    return plain(upsert.upsert_recommendations(*two_runs(spark, folder), unique=True))


@query("explode_recs", f"WITH {RECS} SELECT userId, movieId, score FROM recs")
def explode_recs(spark, folder):
    """The lists of all users as arrays, the way models return them, and back to rows."""
    lists = warehouse.recommendation(spark, folder).groupBy(F.col("userId").alias("user")).agg(
        F.collect_list(F.struct(F.col("movieId").alias("item"), F.col("score").alias("rating")))
        .alias("recommendations"))
    return als.explode_recs(lists)


@query("recs_for", f"WITH {RECS} SELECT userId, movieId, score, rank FROM recs WHERE userId = 7 AND algorithm = 'ALS'")
def recs_for(spark, folder):
    return plain(filters.recs_for(warehouse.recommendation(spark, folder), 7).select(
        "userId", "movieId", "score", "rank"))


RECS_VIEW = f"""{RECS}, movie_stats AS (
  SELECT movieId, CAST((20 * sum(CAST(rating * 10 AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 100.0
           AS avgRating, count(*) AS ratingCount FROM rating_log GROUP BY movieId),
{MOVIE},
view AS (
  SELECT recs.userId, recs.movieId, score, rank, '基于您的观影偏好推荐（算法：' || algorithm || '）' AS reason,
         created_at AS updatedAt, CAST(movie.id AS VARCHAR) AS id, title, genres, year, posterUrl,
         COALESCE(s.avgRating, 0.0) AS avgRating, description
  FROM recs JOIN movie ON movie.id = recs.movieId LEFT JOIN movie_stats s ON s.movieId = movie.id)"""


@query("user_recs_view", f"WITH {RECS_VIEW} SELECT * FROM view")
def user_recs_view(spark, folder):
    view = joins.user_recs_view(warehouse.recommendation(spark, folder), warehouse.rated_movie(spark, folder))
    return plain(view.select("*", "movie.*").drop("movie"))


@query("user_recs_page", f"WITH {RECS_VIEW} SELECT * FROM view WHERE userId = 7 ORDER BY rank, score DESC, movieId LIMIT 8")
def user_recs_page(spark, folder):
    mine = filters.recs_for(warehouse.recommendation(spark, folder), 7)
    view = joins.user_recs_view(mine, warehouse.rated_movie(spark, folder))
    return plain(ranking.paginate(view, ranking.by_rank(), 1, 8).select("*", "movie.*").drop("movie"))


REPORT = f"""{RECS}, {MOVIE}, {USER},
report AS (
  SELECT recs.userId, userAccount, title, score, rank, movieId
  FROM recs JOIN users ON users.id = recs.userId JOIN movie ON movie.id = recs.movieId)"""


def report(spark, folder):
    return joins.rec_report(
        warehouse.user(spark, folder), warehouse.recommendation(spark, folder), warehouse.movie(spark, folder))


@query("rec_report", f"WITH {REPORT} SELECT * FROM report")
def rec_report(spark, folder):
    return plain(report(spark, folder))


@query("rec_report_top", f"WITH {REPORT} SELECT * FROM report ORDER BY userId, rank, movieId LIMIT 20")
def rec_report_top(spark, folder):
    return plain(ranking.paginate(report(spark, folder), [F.col("userId"), F.col("rank"), F.col("movieId")]))


@query("rec_status", f"""WITH {RECS}, {USER}
SELECT users.id AS userId, count(recs.movieId) AS total, count(recs.movieId) > 0 AS isPersonalized
FROM users LEFT JOIN recs ON recs.userId = users.id GROUP BY users.id""")
def rec_status(spark, folder):
    return joins.rec_status(warehouse.user(spark, folder), warehouse.recommendation(spark, folder))


@query("recs_with_fallback", f"""WITH {RECS_VIEW}, {USER},
best AS (
  SELECT movie.id AS movieId,
         CAST(row_number() OVER (ORDER BY COALESCE(s.avgRating, 0) DESC, movie.id) AS INTEGER) AS rank
  FROM movie LEFT JOIN movie_stats s ON s.movieId = movie.id QUALIFY rank <= 8)
SELECT userId, movieId, rank, TRUE AS isPersonalized FROM recs WHERE rank <= 8
UNION ALL
SELECT users.id, best.movieId, best.rank, FALSE FROM users, best WHERE users.id NOT IN (SELECT userId FROM recs)""")
def recs_with_fallback(spark, folder):
    return ranking.recs_with_fallback(
        warehouse.user(spark, folder), warehouse.recommendation(spark, folder), warehouse.rated_movie(spark, folder))


@query("epoch_seconds", """
SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(floor(epoch(ts)) AS BIGINT) * 1000 + 999
                      ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS given,
       CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""")
def epoch_seconds(spark, folder):
    seconds = times.clock_epoch(F.col("ts"))
    given = F.when(F.col("event_type") == "click", seconds * 1000 + 999).otherwise(seconds)
    return warehouse.table(spark, folder, "events").select("event_id", given.alias("given")).withColumn(
        "seconds", times.epoch_seconds(F.col("given")))


@query("half_star", """
SELECT event_id, round_even(least(5.0, greatest(1.0, value / 4)) * 2, 0) / 2 AS rating FROM events""")
def half_star(spark, folder):
    return warehouse.table(spark, folder, "events").select(
        "event_id", numbers.half_star(F.col("value") / 4).alias("rating"))


@query("trending", f"""WITH {EVENT},
counts AS (SELECT timestamp // 86400 * 86400 AS start, movieId, count(*) AS n FROM event GROUP BY 1, 2)
SELECT start, movieId, n, CAST(row_number() OVER (PARTITION BY start ORDER BY n DESC, movieId) AS INTEGER) AS place
FROM counts QUALIFY place <= 10""")
def trending(spark, folder):
    events = warehouse.rating_events(warehouse.table(spark, folder, "events"))
    return plain(ranking.trending(events.withColumn("eventTime", times.event_time(F.col("timestamp")))))
