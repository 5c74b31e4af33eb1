"""Schemas of the four tables, the three files, the two event streams and the item document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, INT, BYTE, TEXT = T.LongType(), T.IntegerType(), T.ByteType(), T.StringType()
DOUBLE, MOMENT = T.DoubleType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    """A schema from names and types; needs no session."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


USER = struct(id=LONG, userName=TEXT, userAccount=TEXT, gender=BYTE, mlUserId=LONG, source=TEXT,
              created_at=MOMENT, updated_at=MOMENT)

MOVIE = struct(id=LONG, title=TEXT, originalTitle=TEXT, genres=TEXT, year=INT, director=TEXT, actors=TEXT,
               description=TEXT, posterUrl=TEXT, mlMovieId=LONG, imdbId=TEXT, tmdbId=TEXT, source=TEXT,
               avgRating=T.DecimalType(3, 2), ratingCount=INT, created_at=MOMENT, updated_at=MOMENT)

RATING = struct(userId=LONG, movieId=LONG, rating=T.DecimalType(2, 1), timestamp=LONG,
                created_at=MOMENT, updated_at=MOMENT)

RECOMMENDATION = struct(userId=LONG, movieId=LONG, score=T.DecimalType(10, 8), rank=INT, algorithm=TEXT,
                        created_at=MOMENT)

# Files arrive as text; parse_or_reject casts them and keeps what does not parse.
MOVIES_CSV = struct(movieId=TEXT, title=TEXT, genres=TEXT)
LINKS_CSV = struct(movieId=TEXT, imdbId=TEXT, tmdbId=TEXT)
RATINGS_CSV = struct(userId=TEXT, movieId=TEXT, rating=TEXT, timestamp=TEXT)

RATING_EVENT = struct(userId=LONG, movieId=LONG, rating=DOUBLE, timestamp=LONG)

ITEM_EVENT = struct(tmdbId=TEXT, title=TEXT, originalTitle=TEXT, genres=TEXT, year=INT, director=TEXT, actors=TEXT,
                    description=TEXT, posterUrl=TEXT, avgRating=DOUBLE, ratingCount=INT)

ITEM_DOCUMENT = struct(
    id=LONG, title=TEXT, original_title=TEXT, overview=TEXT, release_date=TEXT, poster_path=TEXT,
    vote_average=DOUBLE, vote_count=INT, genres=T.ArrayType(struct(name=TEXT)),
    credits=struct(cast=T.ArrayType(struct(name=TEXT)), crew=T.ArrayType(struct(name=TEXT, job=TEXT))))

# Ratings of a movie: their sum in tenths and their number.
STAT_SUMS = struct(movieId=LONG, sum10=LONG, n=LONG)

INGEST_CLOCK = struct(stream=TEXT, latest=LONG)

INGEST_COUNTS = struct(stream=TEXT, batch=TEXT, imported=LONG, rejected=LONG, late=LONG)

LAST_ID = struct(table=TEXT, last=LONG)

TREND_COUNTS = struct(start=MOMENT, movieId=LONG, n=LONG)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, in its order and types."""
    return df.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in schema])
