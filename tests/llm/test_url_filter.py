import random
import re

import pytest

from tastemill.llm import url_filter as uf


@pytest.mark.parametrize("url, host, path", [
    (None, "", ""), ("", "", ""), ("a.com/x", "", ""), ("http://A.COM", "a.com", ""), ("http://É.a?x/y", "É.a", ""),
    ("x://h/p/q?r#s", "h", "/p/q"), ("x://h#/p", "h", ""), ("x://://y", ":", "//y"),
])
def test_split(url, host, path):
    assert uf.split_url(url) == (host, path)


@pytest.mark.parametrize("host, path, rule", [
    ("com", "/", "com/"), ("a.com", "", None), ("b.example.com", "/en/1", "example.com/en/"), ("example.com", "/en", "com/"),
    ("www.example.com", "/en/", "www.example.com/en/"), ("xexample.com", "/en/", "com/"), ("net", "/es/x", "net/es/"),
    ("a.net", "/de/", None), ("", "", None),
])
def test_rules(host, path, rule):
    assert uf.rule_for(host, path, uf.by_host(uf.RULES))[0] == rule


@pytest.mark.parametrize("url, found", [
    ("http://porn.org/", {"porn"}), ("http://porno.org", {"porno"}), ("http://sporn.org", set()), ("cheap-cheap", {"cheap"}),
    ("CHEAP.PILLS", {"cheap", "pills"}), ("éporné", {"porn"}), ("porn1", set()), ("", set()),
])
def test_boundaries(url, found):
    assert set(uf.hits(url, uf.Vocabulary().automaton())) == found


def test_table(spark):
    rows = [(1, "http://a.org/x", "h", "r"), (2, "http://cheap.org/pills", None, None), (3, "http://cheap.org/cheap", "", ""),
            (4, None, None, None), (5, "http://casino.com/", None, None), (5, "http://casino.com/", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in uf.judge_urls(df).collect() if r.page_id != 4)
    assert got == [(1, None, "allow"), (2, None, "block"), (3, None, "allow"), (5, "com/", "allow"), (5, "com/", "allow")]
    assert uf.judge_urls(df.limit(0)).count() == 0


def test_equally_long_rules():
    rules = [("block", "a.org/x/"), ("allow", "a.org/y/"), ("allow", "a.org/x/")]
    assert uf.rule_for("b.a.org", "/x/1", uf.by_host(rules)) == ("a.org/x/", "block")  # the first of two alike
    assert uf.rule_for("a.org", "/y/x/", uf.by_host(rules)) == ("a.org/y/", "allow")
    assert uf.rule_for("b.a.org", "/", uf.by_host([("block", "org//"), ("allow", "a.org/"), ("block", "b.a.org/")])) == ("b.a.org/", "block")


@pytest.mark.parametrize("soft_hits", [1, 2, 3])
def test_vocabulary_of_a_table(spark, soft_hits):
    rng = random.Random(soft_hits)
    words = ["".join(rng.choice("ab1é") for _ in range(rng.randint(1, 3))) for _ in range(40)]
    rows = [(w if k % 5 else w.upper(), [True, None, False, False][k % 4], "x") for k, w in enumerate(words)]
    table = spark.createDataFrame([*rows, (None, True, "y"), ("", True, "z")], "term string, strict boolean, url string")
    vocabulary = uf.read_vocabulary(table, soft_hits)
    assert not set(vocabulary.strict) & set(vocabulary.soft) and {*vocabulary.strict, *vocabulary.soft} == set(map(uf.lower_ascii, words_of(rows)))
    urls = [f"{rng.choice(('http://h.net/q/', 'x', '://'))}" + "".join(rng.choice("abAB1é-/.") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = uf.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), (), vocabulary)
    for r in got.collect():
        text = uf.lower_ascii(urls[r.page_id])
        strict, soft = (sum(bool(re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", text)) for t in terms)
                        for terms in (vocabulary.strict, vocabulary.soft))
        wanted = "block" if strict or soft >= soft_hits else "allow"
        assert r.verdict == wanted, (urls[r.page_id], strict, soft)
        if soft_hits > 1:
            assert (r.n_strict, r.n_soft) == (strict, soft)


def words_of(rows):
    return [term for term, *_ in rows]


def test_vocabularies_without_terms_and_with_too_many(spark, monkeypatch):
    none = spark.createDataFrame([], "term string, strict boolean")
    df = spark.createDataFrame([(1, "http://porn.org/casino"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in uf.judge_urls(df, (), uf.read_vocabulary(none)).collect()} == {"allow"}
    monkeypatch.setattr(uf, "TERMS", 3)
    with pytest.raises(ValueError):
        uf.read_vocabulary(spark.createDataFrame([(t, True) for t in "abcd"], "term string, strict boolean"))
