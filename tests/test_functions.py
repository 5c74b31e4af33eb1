"""Edge values of the column functions."""

import datetime
import json
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tastemill import schemas
from tastemill.functions import numbers, text, times
from tastemill.functions.documents import flatten_items, parse_message, to_message


def apply(spark, values, kind, *columns):
    df = spark.createDataFrame([(place, value) for place, value in enumerate(values)], f"place int, x {kind}")
    named = [column.alias(f"c{place}") for place, column in enumerate(columns)]
    return [tuple(row)[1:] for row in df.select("place", *named).orderBy("place").collect()]


def test_title_year(spark):
    title, year = text.split_title_year(F.col("x"))
    given_titles = ["Toy Story (1995)", "Foo (1995) (2001) ", "Bar", "(1999)", "Baz (199)", " Wide (2000)\t", None]
    assert apply(spark, given_titles, "string", title, year) == [
        ("Toy Story", 1995), ("Foo (1995)", 2001), ("Bar", None), ("", 1999), ("Baz (199)", None), ("Wide", 2000),
        (None, None)]


def test_genres(spark):
    x = F.col("x")
    given_genres = ["A|B", "|A||B|", "", "(no genres listed)", None]
    assert apply(spark, given_genres, "string", text.genre_list(x), text.first_genre(x), text.clean_genres(x)) == [
        (["A", "B"], "A", "A|B"), (["A", "B"], "A", "|A||B|"), ([], None, ""),
        (["(no genres listed)"], "(no genres listed)", None), (None, None, None)]


def test_blank_and_names(spark):
    x = F.col("x")
    assert apply(spark, ["  ", "", " a ", None], "string", text.blank_to_null(x), text.name_or_anonymous(x)) == [
        (None, "  "), (None, "匿名用户"), ("a", " a "), (None, "匿名用户")]
    assert apply(spark, ["/p.jpg", "", None], "string", text.poster_url(x)) == [
        ("https://image.tmdb.org/t/p/w500/p.jpg",), (None,), (None,)]


def test_search_ignores_case_and_accents(spark):
    titles = ["Amélie", "AMELIE", "Amelia", "élan", None]
    hits = apply(spark, titles, "string", text.contains_folded(F.col("x"), "amelie"))
    assert hits == [(True,), (True,), (False,), (False,), (None,)]


def test_epochs(spark):
    x = F.col("x")
    values = apply(spark, [1728600000, 1728600000000, 1728600000999, None], "bigint", times.epoch_seconds(x))
    assert values == [(1728600000,)] * 3 + [(None,)]
    assert apply(spark, [0], "bigint", times.event_time(x))[0][0] == datetime.datetime(1970, 1, 1)


def test_years(spark):
    dates = ["1999-03-30", "1999", "", "soon", "-1", None]
    assert apply(spark, dates, "string", times.release_year(F.col("x"))) == [
        (1999,), (1999,), (None,), (None,), (None,), (None,)]


def test_dates(spark):
    moments = [datetime.datetime(2024, 1, 5, 12, 0), None]
    assert apply(spark, moments, "timestamp", times.show_date(F.col("x"))) == [("2024/1/5",), ("",)]


def test_clock_needs_no_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(1,)], "a int").select(
        F.lit("2024-03-31 02:30:05").cast("timestamp_ntz").alias("x"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(times.clock_epoch(F.col("x"))).first()[0] == 1711852205
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_half_star(spark):
    values = [0.2, 2.25, 3.75, 9.0, 2.75, None]
    expected = [None if v is None else round(max(1.0, min(5.0, v)) * 2) / 2 for v in values]
    assert [row[0] for row in apply(spark, values, "double", numbers.half_star(F.col("x")))] == expected
    assert expected[:4] == [1.0, 2.0, 4.0, 5.0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10000), min_size=20, max_size=60))
def test_votes_round_like_stored_values(spark, thousandths):
    votes = [t / 1000 for t in thousandths]
    rows = apply(spark, votes, "double", numbers.rescale_vote(F.col("x")))
    assert [row[0] for row in rows] == [round(vote / 2, 2) for vote in votes]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 500000), min_size=20, max_size=60))
def test_one_place_ties_go_up(spark, parts):
    values = [p / 100000 for p in parts]

    def one_place(value):
        tenths = Fraction(value) * 10
        whole = int(tenths)
        return f"{(whole + (tenths - whole >= Fraction(1, 2))) / 10:.1f}"

    rows = apply(spark, values, "double", numbers.one_place(F.col("x")))
    assert [row[0] for row in rows] == [one_place(value) for value in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.integers(-3_000_000, 3_000_000).map(lambda t: t / 1000), st.floats(-1e17, 1e17)), min_size=20, max_size=60))
def test_one_rule_for_values_of_any_size(spark, values):
    values += [10.045, 10.055, 9.995, 1e15 + 0.125, 0.0, -2.675, 1e300]
    rows = apply(spark, values, "double", numbers.round_stored(F.col("x"), 2))
    assert [row[0] for row in rows] == [float(round(Fraction(v) * 100)) / 100 if abs(v) < 2**52 else v for v in values]


def test_missing_numbers(spark):
    assert apply(spark, [None], "double", numbers.rescale_vote(F.col("x")), numbers.one_place(F.col("x")),
                 numbers.or_zero(F.col("x"))) == [(0.0, "0.0", 0.0)]
    assert [r[0] for r in apply(spark, ["0.00", None, "3.25"], "string",
                                numbers.average_label(F.col("x").cast("decimal(3,2)")))] == ["暂无", "暂无", "3.3"]


def test_mean_is_rounded_once(spark):
    # 37,501 ratings of 1.0 and 12,500 of 1.5 average 1.1249975.
    df = spark.createDataFrame([(37501 * 10 + 12500 * 15, 50001), (25, 2), (10, 3)], "s bigint, n bigint")
    rows = df.select(numbers.mean_of_tenths(F.col("s"), F.col("n"))).collect()
    assert [str(row[0]) for row in rows] == ["1.12", "1.25", "0.33"]


def test_json_never_fails(spark):
    values = ["oops", "{}", "[]", None, '{"userId":"x","movieId":1}', '{"userId":1.5,"movieId":2}',
              '{"userId":1,"movieId":2,"rating":3.5,"timestamp":4}']
    df = spark.createDataFrame([(v,) for v in values], "value string").select(F.encode("value", "UTF-8").alias("value"))
    rows = parse_message(df, schemas.RATING_EVENT).collect()
    assert [tuple(row)[:4] for row in rows] == [(None,) * 4] * 4 + [
        (None, 1, None, None), (None, 2, None, None), (1, 2, 3.5, 4)]
    assert [row["raw"] for row in rows] == values


def test_flatten_documents(spark, folder):
    docs = [
        {"id": 1, "title": "A", "vote_average": 8.01, "vote_count": 3, "release_date": "2001-02-03",
         "poster_path": "/a.jpg", "genres": [{"name": "X"}, {"name": "Y"}],
         "credits": {"cast": [{"name": str(i)} for i in range(7)],
                     "crew": [{"name": "w", "job": "Writer"}, {"name": "d", "job": "Director"},
                              {"name": "e", "job": "Director"}]}},
        {"id": 2},
        {"id": 3, "title": "", "genres": [], "credits": {"cast": [], "crew": []}, "poster_path": ""},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    parsed = df.select(F.from_json("value", schemas.ITEM_DOCUMENT).alias("d")).select("d.*")
    rows = {row["tmdbId"]: row.asDict() for row in flatten_items(parsed).collect()}
    assert rows["1"]["actors"] == "0|1|2|3|4" and rows["1"]["director"] == "d" and rows["1"]["genres"] == "X|Y"
    assert rows["1"]["avgRating"] == round(8.01 / 2, 2) and rows["1"]["year"] == 2001
    for key in ("2", "3"):
        empty = rows[key]
        assert empty["title"] == "" and empty["avgRating"] == 0.0 and empty["ratingCount"] == 0
        assert all(empty[name] is None for name in ("genres", "year", "director", "actors", "posterUrl"))


def test_messages_keep_text(spark):
    df = spark.createDataFrame([("肖申克", 1)], "title string, n int")
    value = to_message(df).first()[0]
    assert json.loads(bytes(value).decode("utf-8")) == {"title": "肖申克", "n": 1}
