"""File readers: the three CSV files, nested item documents, the seed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill import fixed, schemas

CSV_SCHEMAS = {"movies": schemas.MOVIES_CSV, "links": schemas.LINKS_CSV, "ratings": schemas.RATINGS_CSV}


MALFORMED = "malformed"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, malformed: bool = False) -> DataFrame:
    """Header CSV where a quote inside a quoted field is doubled; columns stay text.

    With ``malformed`` a column of that name holds the text of lines with too few or too many fields, and is null otherwise.
    """
    if malformed:
        schema = T.StructType([*schema, T.StructField(MALFORMED, T.StringType())])
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', enforceSchema=False,
                          columnNameOfCorruptRecord=MALFORMED if malformed else None)


def split_malformed(files: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The files without their malformed lines, and those lines (``file, line``); None if the files were read without."""
    told = {name: df for name, df in files.items() if MALFORMED in df.columns}

    def part(df: DataFrame, fits: Column) -> DataFrame:
        # The second half is always true: Spark counts the fields of a line only where all its columns are asked for.
        fields = [F.col(field.name) for field in df.schema if field.name != MALFORMED and isinstance(field.dataType, T.StringType)]
        return df.where(fits & (F.concat_ws("", *fields) >= ""))

    lines = [part(df, F.col(MALFORMED).isNotNull()).select(F.lit(name).alias("file"), F.col(MALFORMED).alias("line"))
             for name, df in told.items()]
    clean = {name: part(df, F.col(MALFORMED).isNull()).drop(MALFORMED) for name, df in told.items()}
    return files | clean, reduce(DataFrame.unionByName, lines) if lines else None


def with_arrival(files: DataFrame) -> DataFrame:
    """Where each row stands in its files, as a struct that sorts like the lines do: file, block of the file, row."""
    return files.withColumn("arrival", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def read_movielens(spark: SparkSession, folder: str, malformed: bool = False) -> dict[str, DataFrame]:
    """The catalogue, link and rating files of one folder (``<name>.csv``, a file or a folder of parts).

    Movies and links keep their order of arrival: of lines with one id the last counts. ``malformed`` as in ``read_csv``.
    """
    files = {name: read_csv(spark, f"{folder}/{name}.csv", schema, malformed) for name, schema in CSV_SCHEMAS.items()}
    return files | {name: with_arrival(files[name]) for name in ("movies", "links")}


def read_item_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested item documents, one JSON object per line."""
    return spark.read.schema(schemas.ITEM_DOCUMENT).json(path)


def stream_item_json(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.ITEM_DOCUMENT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def stream_text(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON lines landing in a folder as a stream with the ``value`` column of a message topic."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def seed_movies(spark: SparkSession) -> DataFrame:
    """The rows a new catalogue starts with."""
    schema = "id bigint, title string, genres string, year int, description string, avgRating string, ratingCount int"
    rows = spark.createDataFrame(fixed.SEED_MOVIES, schema)
    return rows.withColumns({
        "avgRating": F.col("avgRating").cast("decimal(3,2)"),
        "source": F.lit(fixed.SOURCE_CATALOGUE),
    })
