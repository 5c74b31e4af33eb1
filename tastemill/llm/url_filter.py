"""Page addresses judged by host and path rules, and by a weighted vocabulary where no rule fits.

The vocabulary is searched with one Aho-Corasick automaton, so an address is read once however many terms
there are. A term counts only between boundaries (no ASCII letter or digit on either side). One strict term
rejects an address; soft terms reject it only when several different ones occur.

Nulls, and addresses without ``://``, have an empty host and path; no rule fits them, and their text (if any)
is still judged by the vocabulary. Repeated addresses get equal verdicts; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm.registry import query, table

# The rules of the contract.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
STRICT = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "porno", "sexcam", "spam", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "bet", "bets", "bonus", "cheap", "crack", "drugs", "farm", "free", "gambling", "hot", "jackpot", "keygen",
        "loan", "nude", "pharma", "pills", "poker", "sex", "torrent", "track",
        "tracker", "win")
SOFT_HITS = 2
TERMS = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case; ``soft_hits`` different soft terms weigh as much as a strict one."""

    strict: Sequence[str] = STRICT
    soft: Sequence[str] = SOFT
    soft_hits: int = SOFT_HITS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for weight, terms in ((1, self.soft), (self.soft_hits, self.strict)):  # a term in both lists is strict
            for term in terms:
                found.add_word(term, (term, weight))
        found.make_automaton()
        return found


_UPPER_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UPPER = str.maketrans(*_UPPER_LOWER)


def lower_ascii(text: str) -> str:
    return text.translate(_UPPER)


def read_vocabulary(terms: DataFrame, soft_hits: int = SOFT_HITS) -> Vocabulary:
    """The vocabulary of a table with ``term`` and ``strict`` (boolean; null is soft), in place of the one above.

    Terms are compared in lower case (ASCII); null and empty ones are left out, a term of both kinds is strict, other columns do
    not matter. A table without terms blocks nothing. More than ``TERMS`` different terms are refused, not cut: each task holds all.
    """
    kinds = terms.where("term <> ''").groupBy(F.translate("term", *_UPPER_LOWER).alias("term")).agg(
        F.max(F.coalesce("strict", F.lit(False))).alias("strict"))
    rows = sorted((r["term"], r["strict"]) for r in kinds.limit(TERMS + 1).collect())
    if len(rows) > TERMS:
        raise ValueError(f"a vocabulary has at most {TERMS} terms")
    return Vocabulary(tuple(t for t, s in rows if s), tuple(t for t, s in rows if not s), soft_hits)


def _first(text: str, marks: str) -> int:
    return min((at for at in map(text.find, marks) if at >= 0), default=len(text))


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case and path of an address."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = _first(rest, "/?#")
    path = rest[end:]
    return lower_ascii(rest[:end]), path[:_first(path, "?#")]


def rule_for(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """Longest rule that fits and its verdict; of equally long ones the first. Only suffixes of the host are looked up."""
    best: tuple[str | None, str | None] = (None, None)
    at = 0
    while True:
        for rule_path, rule, verdict in rules.get(host[at:], ()):
            if path.startswith(rule_path) and len(rule) > len(best[0] or ""):
                best = rule, verdict
        at = host.find(".", at) + 1
        if not at:
            return best


def by_host(rules: Sequence[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    hosts: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        at = rule.index("/")
        hosts.setdefault(rule[:at], []).append((rule[at:], rule, verdict))
    return hosts


def hits(url: str, automaton: ahocorasick.Automaton) -> dict[str, int]:
    """Different terms between boundaries, with their weights."""
    text, found = lower_ascii(url), {}
    for end, (term, weight) in automaton.iter(text) if len(automaton) else ():
        begin = end - len(term) + 1
        if not (_word(text, begin - 1) or _word(text, end + 1)):
            found[term] = weight
    return found


def _word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, vocabulary: Vocabulary = Vocabulary(),
               key: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, rule and verdict of every address, with the counts of strict and of different soft terms.

    One pass without a shuffle; only the key and the address are read.
    """
    kind = pages.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, hosts = vocabulary.automaton(), by_host(rules)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                host, path = split_url(text)
                rule, verdict = rule_for(host, path, hosts)
                weights = list(hits(text or "", automaton).values())
                strict = sum(w >= vocabulary.soft_hits for w in weights)
                if verdict is None:
                    verdict = "block" if sum(weights) >= vocabulary.soft_hits else "allow"
                rows.append((host, path, rule, verdict, strict, len(weights) - strict))
            host, path, rule, verdict, strict, soft = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict)),
                 pa.array(strict, pa.int64()), pa.array(soft, pa.int64())],
                names=[key, "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return pages.select(key, url).mapInArrow(
        judge, f"`{key}` {kind}, host string, path string, rule string, verdict string, n_strict long, n_soft long")


def _sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(((v, *_cut(r)) for v, r in RULES), key=lambda x: -len(x[1] + x[2])))
    verdicts = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for verdict, rule in RULES)

    def count(terms: Sequence[str]) -> str:
        return " + ".join(
            f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)

    upper, lower = _UPPER_LOWER
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
         coalesce(CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) END, '') AS rest FROM pages),
split AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (
  SELECT *, CASE {fits} END AS rule, {count(STRICT)} AS n_strict, {count(SOFT)} AS n_soft FROM split)
SELECT page_id, host, path, rule, n_strict, n_soft,
       CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END
            WHEN n_strict >= 1 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


def _cut(rule: str) -> tuple[str, str]:
    at = rule.index("/")
    return rule[:at], rule[at:]


@query("op6_url_filters", _sql())
def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))
