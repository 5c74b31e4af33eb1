"""The canonical tables as common table expressions, written apart from the Spark views they check."""

from __future__ import annotations

CUTOFF = 946684800  # 2000-01-01
NOW = 1717200000  # 2024-06-01
LOADED = 1704067200  # 2024-01-01

RATING_LOG = """rating_log AS (
  SELECT o_custkey AS userId, l_partkey AS movieId,
         CAST(1.0 + 0.5 * ((CAST(l_quantity AS INT) - 1) % 9) AS DECIMAL(2,1)) AS rating,
         CAST(epoch(l_shipdate) AS BIGINT) AS timestamp, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def latest(name: str, source: str, where: str = "TRUE") -> str:
    """One rating per user and movie out of a log."""
    return f"""{name} AS (
  SELECT * FROM {source} WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY userId, movieId ORDER BY timestamp DESC, seq DESC) = 1)"""


def stats(name: str, source: str) -> str:
    """Average with two places and count per movie, in whole numbers."""
    return f"""{name} AS (
  SELECT movieId,
         CAST((20 * sum(CAST(rating * 10 AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 100.0 AS avgRating,
         count(*) AS ratingCount
  FROM {source} GROUP BY movieId)"""


RATING = latest("rating", "rating_log")

MOVIE = """movie AS (
  SELECT p_partkey AS id, p_name AS title,
         CASE WHEN p_size > 2 THEN p_name || ' (' || (1950 + p_size) || ')' ELSE p_name END AS originalTitle,
         CASE WHEN p_size > 1 THEN p_type || '|' || p_brand END AS genres,
         CASE WHEN p_size > 2 THEN 1950 + p_size END AS year,
         CAST(NULL AS VARCHAR) AS director, CAST(NULL AS VARCHAR) AS actors,
         p_name AS description, '/p/' || p_partkey AS posterUrl, p_partkey AS mlMovieId,
         'tt' || p_partkey AS imdbId, CASE WHEN p_size < 46 THEN 't' || p_partkey END AS tmdbId,
         CASE WHEN p_brand = 'Brand#2' THEN 'TMDB' ELSE 'ML' END AS source,
         p_size
  FROM part)"""

MOVIE_STATS = stats("movie_stats", "rating_log")

RATED = f"""rated AS (
  SELECT movie.* EXCLUDE (p_size), COALESCE(s.avgRating, 0.0) AS avgRating,
         CAST(COALESCE(s.ratingCount, 0) AS INTEGER) AS ratingCount,
         CAST({LOADED} AS BIGINT) AS created_at, CAST({LOADED} AS BIGINT) AS updated_at
  FROM movie LEFT JOIN movie_stats s ON s.movieId = movie.id)"""

RATED_MOVIE = f"{RATING_LOG}, {MOVIE_STATS}, {MOVIE}, {RATED}"

USER = """users AS (
  SELECT c_custkey AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS userName,
         'ml_user_' || c_custkey AS userAccount, c_acctbal
  FROM customer)"""

SCORED = """scored AS (
  SELECT userId, movieId, CAST(rating AS DOUBLE) + timestamp / CAST(2000000000 AS DOUBLE) AS score
  FROM rating WHERE rating >= 3)"""


def ranked(name: str, where: str, top_n: int, created: int = LOADED) -> str:
    return f"""{name} AS (
  SELECT userId, movieId, CAST(CAST(score AS DECIMAL(10,8)) AS DOUBLE) AS score,
         CAST(row_number() OVER (PARTITION BY userId ORDER BY scored.score DESC, movieId) AS INTEGER) AS rank,
         'ALS' AS algorithm, CAST({created} AS BIGINT) AS created_at
  FROM scored WHERE {where} QUALIFY rank <= {top_n})"""


RECS = f"{RATING_LOG}, {RATING}, {SCORED}, {ranked('recs', 'scored.score >= 5', 20)}"

ITEM = """item AS (
  SELECT CAST(p_partkey AS VARCHAR) AS tmdbId,
         CASE WHEN p_size = 7 THEN '' ELSE p_name END AS title, p_name AS originalTitle,
         CASE WHEN p_size NOT IN (47, 48) THEN p_type || '|' || p_brand END AS genres,
         CASE WHEN p_size > 4 THEN 1950 + p_size END AS year,
         CASE WHEN p_size > 5 THEN 'Boss ' || p_partkey WHEN p_size > 3 THEN 'Second ' || p_partkey END AS director,
         CASE WHEN p_size > 6 THEN 'Actor 1|Actor 2|Actor 3|Actor 4|Actor 5' END AS actors,
         p_brand AS description,
         CASE WHEN p_size > 10 THEN 'https://image.tmdb.org/t/p/w500/' || p_partkey || '.jpg' END AS posterUrl,
         CASE WHEN p_size < 50 THEN CAST(printf('%.2f', p_retailprice / 320 / 2) AS DOUBLE) ELSE 0.0 END AS avgRating,
         CASE WHEN p_size < 49 THEN p_size * 37 ELSE 0 END AS ratingCount
  FROM part)"""

EVENT = """event AS (
  SELECT event_id, event_type, user_id AS userId, CAST(json_extract(props, '$.k') AS BIGINT) AS movieId,
         round_even(least(5.0, greatest(1.0, 1 + value % 4)) * 2, 0) / 2 AS rating,
         CAST(floor(epoch(ts)) AS BIGINT) AS timestamp
  FROM events)"""

STREAM_RATING = f"""{EVENT}, stream_rating AS (
  SELECT userId, movieId, CAST(rating AS DECIMAL(2,1)) AS rating, timestamp FROM event WHERE event_type <> 'error'
  QUALIFY row_number() OVER (PARTITION BY userId, movieId ORDER BY timestamp DESC, rating DESC) = 1)"""


def to_fixed_one(x: str) -> str:
    """Text with one place, by the stored value; real ties go up."""
    return (f"CASE WHEN {x} * 4 = floor({x} * 4) AND CAST({x} * 4 AS BIGINT) % 2 = 1 "
            f"THEN printf('%.1f', {x} + 0.01) ELSE printf('%.1f', {x}) END")
