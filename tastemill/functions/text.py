"""Text columns: titles, genres, names and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastemill import fixed

FOLDING = "UNICODE_CI_AI"


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_title_year(text: Column) -> tuple[Column, Column]:
    """Title without a trailing ``(yyyy)``, and that year (null where there is none)."""
    whole = strip(text)
    digits = F.regexp_extract(whole, fixed.TITLE_YEAR_PATTERN, 1)
    bare = strip(F.regexp_replace(whole, fixed.TITLE_YEAR_PATTERN, ""))
    return F.when(digits != "", bare).otherwise(whole), F.nullif(digits, F.lit("")).try_cast("int")


def clean_genres(genres: Column) -> Column:
    """Null in place of the marker for a movie without genres."""
    return F.nullif(genres, F.lit(fixed.NO_GENRES))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def genre_list(genres: Column) -> Column:
    """Genres of a ``|``-separated string, empty parts left out."""
    return F.filter(F.split(genres, r"\|"), lambda part: part != "")


def first_genre(genres: Column) -> Column:
    return F.get(genre_list(genres), F.lit(0))


def folded(text: Column) -> Column:
    """The text under the collation that ignores case and accents."""
    return F.collate(text, FOLDING)


def contains_folded(text: Column, part: str | Column) -> Column:
    """Substring test that ignores case and accents."""
    return F.contains(folded(text), folded(F.lit(part) if isinstance(part, str) else part))


def account_name(user_id: Column) -> Column:
    return F.concat(F.lit(fixed.ACCOUNT_PREFIX), user_id.cast("string"))


def display_name(user_id: Column) -> Column:
    return F.concat(F.lit(fixed.DISPLAY_NAME_PREFIX), user_id.cast("string"))


def name_or_anonymous(name: Column) -> Column:
    """An empty name counts as missing, like a null one."""
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(fixed.ANONYMOUS_NAME))


def reason(algorithm: Column) -> Column:
    return F.concat(F.lit(fixed.REASON_BEFORE), algorithm, F.lit(fixed.REASON_AFTER))


def poster_url(path: Column, base: str = fixed.POSTER_BASE) -> Column:
    """Full address of a poster; null for a missing or empty path."""
    return F.concat(F.lit(base), F.nullif(path, F.lit("")))
