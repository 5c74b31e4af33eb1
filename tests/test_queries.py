"""Every query against its SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry_points
from tastemill.plans.registry import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"
# Nothing in the smallest tables meets these conditions.
MAY_BE_EMPTY = {"list_movies_filtered", "list_movies_by_title"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert compare.differences(df, con, CHECKS[name]) == []
    if name not in MAY_BE_EMPTY:
        assert not df.isEmpty()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_without_sql(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["id", "title", "avgRating", "ratingCount"]
    assert df.count() == 10
