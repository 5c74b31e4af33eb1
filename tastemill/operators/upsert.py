"""Insert-or-update of keyed tables as joins.

Every table here is unique in its key, so the joins shuffle evenly however unevenly users or movies
are rated; repeated keys in the updates are reduced with a partial aggregate before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill import fixed
from tastemill.functions.text import account_name, display_name
from tastemill.operators.numbering import dense_index
from tastemill.schemas import conform

RATING_KEY = ("userId", "movieId")
RATING_ORDER = ("timestamp", "rating")
RECOMMENDATION_KEY = ("userId", "movieId", "algorithm")
CATALOGUE_UPDATES = ("title", "genres", "year", "imdbId", "tmdbId")
METADATA_UPDATES = ("title", "originalTitle", "genres", "year", "director", "actors", "description", "posterUrl")
STAT_COLUMNS = ("avgRating", "ratingCount")

_LONE = "row_without_key"

_DIGITS = {"tinyint": 4, "smallint": 6, "int": 11, "bigint": 20}


def _packing(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str, int, int]] | None:
    """Name, type, decimal places and digits of columns that fit together into one decimal of 38 digits, else None."""
    out = []
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, T.DecimalType):
            out.append((name, kind.simpleString(), kind.scale, kind.precision + 1))
        elif kind.simpleString() in _DIGITS:
            out.append((name, kind.simpleString(), 0, _DIGITS[kind.simpleString()]))
        else:
            return None
    return out if sum(x[-1] for x in out) <= 38 else None


def _middle(width: int) -> Column:
    return F.lit(f"5{'0' * (width - 1)}").cast("decimal(38,0)")


def _packed(columns: list[tuple[str, str, int, int]]) -> Column:
    """The columns as one number that sorts like them, nulls first; text is put together digit by digit and is exact."""
    digits = []
    for name, _, scale, width in columns:
        # A value moved to be positive: half of the range above, null as 0.
        moved = (F.col(name).cast("decimal(38,0)") if not scale else (F.col(name) * F.lit(10**scale)).cast("decimal(38,0)")) + _middle(width)
        digits.append(F.lpad(F.coalesce(moved.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string"), width, "0"))
    return F.concat(*digits).cast("decimal(38,0)")


def _unpacked(packed: Column, columns: list[tuple[str, str, int, int]]) -> list[Column]:
    text, at, out = F.lpad(packed.cast("string"), sum(x[-1] for x in columns), "0"), 1, []
    for name, kind, scale, width in columns:
        moved = F.substring(text, at, width).cast("decimal(38,0)")
        value = (moved - _middle(width)).cast("decimal(28,0)")
        if scale:
            value = value / F.lit(10**scale).cast("decimal(10,0)")
        out.append(F.when(moved != 0, value.cast(kind)).alias(name))
        at += width
    return out


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key: the one that is last by ``order_by``, then by all other columns.

    Repeats are reduced before the shuffle. Whole numbers and decimals that fit into 38 digits are reduced as
    one number by a hash aggregate, which sorts nothing; other columns as one struct.
    """
    rest = [name for name in df.columns if name not in keys]
    if not rest:
        return df.select(*keys).distinct()
    ordered = [*order_by, *(name for name in rest if name not in order_by)]
    columns = _packing(df, ordered)
    if columns:
        last = df.groupBy(*keys).agg(F.max(_packed(columns)).alias("last"))
        return last.select(*keys, *_unpacked(F.col("last"), columns)).select(*df.columns)
    last = F.max(F.struct(*ordered)).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, "last.*").select(*df.columns)


def _same_key(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"t.{key}") == F.col(f"u.{key}") for key in keys])


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    order_by: Sequence[str] = (),
    now: Column | None = None,
    defaults: dict[str, Column] | None = None,
    touch: str = "changed",
    keep_newer: bool = False,
    small_updates: bool = False,
    unique_updates: bool = False,
) -> DataFrame:
    """``target`` with ``updates`` merged in by ``keys``.

    A matched row takes ``update_cols`` from the update (nulls too) and keeps everything else. A new
    row takes all columns the updates have, then ``defaults``, then null. With ``now``, a new row
    gets it as ``created_at`` and ``updated_at``; a matched row gets it as ``updated_at`` when one of
    its values changes, or every time with ``touch="always"``. ``keep_newer`` leaves a stored row
    alone that is later by ``order_by`` than the update, so batches may arrive in any order.

    Updates without a complete key are each inserted: a unique key admits many missing ones. Where keys may be missing,
    rows of either side carry a number beside the key, 0 for whole keys and otherwise their own, so rows that match nothing
    spread over the partitions. ``unique_updates`` says that no key is given twice, so updates are not reduced.

    One full outer join by default, which reads either input once. ``small_updates`` is for a batch known to be far smaller than the
    target: joins whose update side Spark can broadcast, so the target is not shuffled; if the batch
    turns out large the same joins run shuffled and the result is the same.
    """
    kinds = {field.name: field.dataType for field in target.schema}
    old = {name: F.col(f"t.{name}") for name in target.columns}
    new = {name: F.col(f"u.{name}").cast(kinds[name]) for name in updates.columns if name in kinds}
    stored = F.col("t.stored").isNotNull()
    given = F.col("u.given").isNotNull()
    if keep_newer:
        later = F.struct(*[new[name].alias(name) for name in order_by]) >= F.struct(
            *[old[name].alias(name) for name in order_by])
        given = given & (~stored | later)
    changed = F.lit(True) if touch == "always" else reduce(
        or_, [~old[name].eqNullSafe(new[name]) for name in update_cols], F.lit(False))

    def merged(name: str) -> Column:
        if name in keys:
            return F.coalesce(old[name], new[name])
        if name in update_cols:
            return F.when(given, new[name]).otherwise(old[name])
        if now is not None and name == "created_at":
            return F.when(stored, old[name]).otherwise(now)
        if now is not None and name == "updated_at":
            return F.when(~stored | (given & changed), now).otherwise(old[name])
        first = [source[name] for source in (new, defaults or {}) if name in source]
        return F.when(stored, old[name]).otherwise(F.coalesce(*first)) if first else old[name]

    columns = [merged(name).cast(kinds[name]).alias(name) for name in target.columns]
    whole = reduce(and_, [F.col(key).isNotNull() for key in keys])
    certain = not any(df.schema[key].nullable for df in (target, updates) for key in keys)
    lone = [] if certain else [_LONE]
    by = [*keys, *lone]

    def told_apart(df: DataFrame) -> DataFrame:
        return df if certain else df.withColumn(_LONE, F.when(whole, F.lit(0)).otherwise(F.monotonically_increasing_id() + 1))

    fresh = told_apart(updates)
    if not unique_updates:
        fresh = latest_per_key(fresh, by, order_by)
    u = fresh.withColumn("given", F.lit(True)).alias("u")
    t = told_apart(target).withColumn("stored", F.lit(True)).alias("t")
    if not small_updates and (update_cols or touch == "always"):
        return t.join(u, _same_key(by), "full_outer").select(*columns)

    def inserted(rows: DataFrame) -> DataFrame:
        # Against an empty target the join is only a projection that fills its columns with nulls.
        return rows.withColumn("given", F.lit(True)).alias("u").join(t.limit(0), _same_key(by), "left").select(*columns)

    known = target.where(whole).select(*keys, *(F.lit(0).cast("bigint").alias(name) for name in lone))
    if not update_cols and touch != "always":
        # Stored rows can not change, so only new keys are looked for.
        return target.unionByName(inserted(fresh.join(known, by, "left_anti")))
    kept = t.join(u, _same_key(by), "left").select(*columns)
    hits = known.join(fresh.select(*by), by, "left_semi")
    return kept.unionByName(inserted(fresh.join(hits, by, "left_anti")))


def touched_rows(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows whose key is among the updates'."""
    return target.join(updates.select(*keys).distinct(), list(keys), "left_semi").select(*target.columns)


def changed_values(target: DataFrame, updates: DataFrame, keys: Sequence[str], value: str, order_by: Sequence[str] = ()) -> DataFrame:
    """What a merge does to one column: ``old`` and ``new`` of every key the updates touch, ``old`` null for new keys.

    ``target`` is read once, and rows without an update leave before anything is shuffled if the updates can be broadcast.
    """
    whole = reduce(and_, [F.col(key).isNotNull() for key in keys])
    fresh = latest_per_key(updates.where(whole).select(*dict.fromkeys([*keys, value, *order_by])), keys, order_by)
    hits = touched_rows(target.select(*keys, F.col(value).alias("old")), fresh, keys)
    return fresh.select(*keys, F.col(value).alias("new")).join(hits, list(keys), "left").select(*keys, "old", "new")


def assign_ids(updates: DataFrame, target: DataFrame, key: str, last: Column | None = None) -> DataFrame:
    """Add the next free ``id`` of ``target`` to updates with an unknown ``key``, in key order.

    With ``last``, the highest id so far, ``target`` needs only its rows with a key of the updates.
    """
    unknown = updates.select(key).where(F.col(key).isNotNull()).distinct().join(target.select(key), key, "left_anti")
    if last is None:
        last = target.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint")).alias("id")).scalar()
    numbered = dense_index(unknown, key, "id").withColumn("id", F.col("id") + 1 + last)
    return updates.drop("id").join(numbered, key, "left")


def upsert_catalogue(movie: DataFrame, staged: DataFrame, now: Column | None = None,
                     order_by: Sequence[str] = ()) -> DataFrame:
    """Catalogue rows by ``mlMovieId``; the original title, source and statistics of known movies stay.

    Of repeated ids the last by ``order_by`` counts (the line number of a file, say).
    """
    return upsert(movie, assign_ids(staged, movie, "mlMovieId"), ["mlMovieId"], CATALOGUE_UPDATES, order_by=order_by, now=now,
                  defaults={"avgRating": F.lit(0), "ratingCount": F.lit(0)})


def upsert_seeds(movie: DataFrame, seeds: DataFrame, now: Column | None = None) -> DataFrame:
    """Seed rows by ``id``; of a known movie only the title is set."""
    return upsert(movie, seeds, ["id"], ["title"], now=now)


def upsert_ratings(rating: DataFrame, updates: DataFrame, now: Column | None = None,
                   order_by: Sequence[str] = RATING_ORDER, keep_newer: bool = False, touch: str = "changed",
                   small_updates: bool = False) -> DataFrame:
    """Ratings by user and movie; the last one by ``order_by`` wins."""
    return upsert(rating, updates, RATING_KEY, ["rating", "timestamp"], order_by=order_by, now=now,
                  keep_newer=keep_newer, touch=touch, small_updates=small_updates)


def upsert_recommendations(old: DataFrame, new: DataFrame, mode: str = "replace_algorithm",
                           algorithm: str = fixed.ALGORITHM, unique: bool = False) -> DataFrame:
    """Publish a run of recommendations; ``unique`` says that it names no user and movie twice, as a ranked run does not.

    ``merge`` updates score, rank and time by user, movie and algorithm and keeps rows the run does
    not mention. ``replace_algorithm`` drops all earlier rows of the run's algorithm, so ranks stay
    gapless; it only filters the stored table.
    """
    if mode == "merge":
        return upsert(old, new, RECOMMENDATION_KEY, ["score", "rank", "created_at"], order_by=["created_at"], unique_updates=unique)
    if mode != "replace_algorithm":
        raise ValueError(f"unknown mode {mode}")
    kept = old.where(~F.col("algorithm").eqNullSafe(F.lit(algorithm)))
    fresh = new.select(*old.columns)
    fresh = fresh if unique else latest_per_key(fresh, RECOMMENDATION_KEY, ["created_at"])
    return kept.unionByName(conform(fresh, old.schema))


def metadata_columns(overwrite_stats: bool = True) -> tuple[str, ...]:
    return METADATA_UPDATES + STAT_COLUMNS if overwrite_stats else METADATA_UPDATES


def stage_metadata(batch: DataFrame, movie: DataFrame, last: Column | None = None) -> DataFrame:
    """Item events ready to be merged: source set, new items with an id (see ``assign_ids``)."""
    return assign_ids(batch, movie, "tmdbId", last).withColumn("source", F.lit(fixed.SOURCE_FEED))


def upsert_metadata(movie: DataFrame, batch: DataFrame, now: Column | None = None, overwrite_stats: bool = True,
                    small_updates: bool = False, order_by: Sequence[str] = ()) -> DataFrame:
    """Item metadata by ``tmdbId``; with ``overwrite_stats`` average and count come from the item too.

    Of several events of one item the last by ``order_by`` counts.
    """
    return upsert(movie, stage_metadata(batch, movie), ["tmdbId"], metadata_columns(overwrite_stats), order_by=order_by,
                  now=now, touch="always", small_updates=small_updates)


def stage_users(ids: DataFrame, id_col: str = "mlUserId") -> DataFrame:
    """User rows for external user ids."""
    key = F.col(id_col)
    return ids.select(
        key.cast("bigint").alias("mlUserId"),
        account_name(key).alias("userAccount"),
        display_name(key).alias("userName"),
        F.lit(fixed.SOURCE_CATALOGUE).alias("source"),
    )


def upsert_users(user: DataFrame, staged: DataFrame, now: Column | None = None) -> DataFrame:
    """Add users whose ``mlUserId`` is new; known users stay as they are."""
    return upsert(user, assign_ids(staged, user, "mlUserId"), ["mlUserId"], [], now=now)


def apply_movie_stats(movie: DataFrame, stats: DataFrame, now: Column | None = None) -> DataFrame:
    """Set average and count on movies that have statistics; all other movies stay unchanged."""
    s = stats.select(F.col("movieId").alias("id"), F.col("avgRating").alias("new_avg"),
                     F.col("ratingCount").cast("int").alias("new_count"))
    joined = movie.join(s, "id", "left")
    changed = F.col("new_count").isNotNull() & ~(
        F.col("avgRating").eqNullSafe(F.col("new_avg")) & F.col("ratingCount").eqNullSafe(F.col("new_count")))
    updates = {"avgRating": F.coalesce("new_avg", "avgRating"), "ratingCount": F.coalesce("new_count", "ratingCount")}
    if now is not None and "updated_at" in movie.columns:
        updates["updated_at"] = F.when(changed, now).otherwise(F.col("updated_at"))
    return joined.withColumns(updates).select(*movie.columns)
