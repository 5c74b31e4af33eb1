"""Secrets in texts: fixed patterns, and credentials in several parts linked by an interval join.

The patterns of the base stand for themselves. Beyond them a text holds weak candidates: things that are an identifier,
a secret or an endpoint only if they stand together (a user name, a short password, a long mixed run of letters and digits,
a host). Each candidate, and each match of the base, is an interval with a role (an access key identifies, the rest of
the base are secrets). Candidates are

- fields, a name and a value with ``:``, ``=`` or ``=>`` between, by the words of the field's name;
- addresses with a scheme, whose host is an endpoint and whose ``user:password@`` is an identifier and a secret;
- loose runs: 20 or more letters, digits and ``+/_-`` with both cases and digits are secrets, 16 to 40 capitals and
  digits identifiers.

Scopes are the stretches of a text between blank lines. An identifier or endpoint joins a secret if it lies in its scope,
at most ``reach`` code points away, and does not overlap it. The intervals of either role are apart, so the
partners of a secret are two ranges of them, found by binary searches for all secrets of a slice of texts at once; no
pairs are listed, however many parts a scope holds.

A weak secret in a field or address is reported if it has a partner; a loose one needs an identifier, one of the base
nothing. A weak identifier is reported if a reported secret has it as a partner, a weak endpoint if that secret has an
identifier too. A link is a reported secret with its nearest identifier and nearest endpoint, ties to the earlier; secrets
without a partner have no link.

Weak candidates never overlap spans of the base, nor each other: of two the one in a field or address stays, then the earlier.
Null and empty texts have no spans. Equal texts have equal spans; positions are code points, ends exclusive. Rows are
handled by themselves, so repeated rows, null ids and other columns change nothing. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm.registry import query, table
from tastemill.llm.textbytes import pieces, utf8

REACH = 200
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE_KINDS = KINDS[:3]
IDENTIFIER, SECRET, ENDPOINT = KINDS[3:]

# The patterns of the contract. The look-behind changes no match, as one takes a whole run of signs.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")

_FIELD = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_.-]{0,40}+)["']?\x20{0,4}(?:=>|[:=])(?!//)\x20{0,4}["']?([^\s"',;<>()\[\]{}]{3,200}+)""")
_ADDRESS = re.compile(r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}+://(?:([^\s:/@"']{1,100}):([^\s/@"']{3,200})@)?([A-Za-z0-9.-]{3,200}(?::[0-9]{1,5})?)""")
_LOOSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,200}+(?![A-Za-z0-9+/_-])")
_BLANK_LINE = re.compile(r"\n[\x20\t\r]*(?=\n)")
_LONG_RUN = 16
_RUN = np.zeros(256, bool)
_RUN[48:58] = _RUN[65:91] = _RUN[97:123] = True
_RUN[[43, 45, 47, 95]] = True

# Names of fields by role, without case and separators.
NAMES = {
    IDENTIFIER: frozenset("user username userid login account accountid accountname clientid client appid accesskeyid accessid keyid tenantid "
                          "consumerkey subscriptionid uid".split()),
    SECRET: frozenset("pwd pass passphrase passcode pin credential credentials authorization bearer privatekey accesskey secretkey "
                      "secretaccesskey clientsecret sharedkey sharedaccesskey signingkey apisecret appsecret consumersecret authkey".split()),
    ENDPOINT: frozenset("host hostname server endpoint url uri baseurl domain database dbname region bucket datasource".split()),
}

LOOSE, NAMED, BASE = range(3)


@dataclass(frozen=True, order=True)
class Part:
    """A candidate or a match of the base; of the latter ``kind`` says which."""

    start: int
    end: int
    kind: str
    strength: int

    @property
    def role(self) -> str:
        return {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET}.get(self.kind, self.kind)


def by_start(found: list[Part]) -> list[Part]:
    return sorted(found, key=lambda p: (p.start, KINDS.index(p.kind), p.end))


def base_parts(text: str, long_runs: bool = True) -> list[Part]:
    """Matches of the fixed patterns by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [Part(*m.span(), "assign", BASE) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if long_runs:
        found += [Part(*m.span(), "access", BASE) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        found += [Part(*m.span(), "hex", BASE) for m in _HEX.finditer(text)]
    return by_start(found)


def _mixed(value: str) -> bool:
    """Neither a plain word nor a plain number."""
    value = value.strip(".:/!?")
    return any(map(str.isdigit, value)) + any(map(str.isalpha, value)) + any(not c.isalnum() for c in value) >= 2


def _role(name: str) -> str | None:
    """The role of a field by its whole name, or by the part behind its last dot."""
    for part in (name, name.rpartition(".")[2]):
        plain = re.sub("[_.-]", "", part).lower()
        for role, names in NAMES.items():
            if plain in names:
                return role
    return None


def _weak(text: str, long_runs: bool) -> Iterator[Part]:
    if ":" in text or "=" in text:
        for m in _FIELD.finditer(text):
            role = _role(m[1])
            if role and (role != SECRET or len(m[2]) >= 4 and _mixed(m[2])):
                yield Part(*m.span(2), role, NAMED)
        if "://" in text:
            for m in _ADDRESS.finditer(text):
                if m[1]:
                    yield Part(*m.span(1), IDENTIFIER, NAMED)
                    yield Part(*m.span(2), SECRET, NAMED)
                yield Part(*m.span(3), ENDPOINT, NAMED)
    if long_runs:
        for m in _LOOSE.finditer(text):
            digits, upper, lower = (sum(map(of, m[0])) for of in (str.isdigit, str.isupper, str.islower))
            if min(digits, upper, lower) >= 3 and len(m[0]) >= 20:
                yield Part(*m.span(), SECRET, LOOSE)
            elif min(digits, upper) >= 3 and digits + upper == len(m[0]) <= 40:
                yield Part(*m.span(), IDENTIFIER, LOOSE)


def weak_parts(text: str, base: list[Part], long_runs: bool = True) -> list[Part]:
    """Candidates that overlap neither the base nor each other, by start."""
    weak = sorted(_weak(text, long_runs), key=lambda p: (-p.strength, p.start, p.end))
    if not any(p.role == SECRET for p in (*base, *weak)):
        return []  # nothing could be linked
    kept: list[Part] = []
    busy = sorted((p.start, p.end) for p in base)
    for strength in (NAMED, LOOSE):
        # Intervals taken so far as separate stretches; a candidate is free if it begins behind one and ends before the next.
        starts, ends = np.array([s for s, _ in busy], np.int64), np.maximum.accumulate(np.array([e for _, e in busy], np.int64))
        last = -1
        for p in (p for p in weak if p.strength == strength):
            at = int(np.searchsorted(starts, p.end))
            if p.start >= last and (at == 0 or ends[at - 1] <= p.start):
                kept.append(p)
                last = p.end
        busy = sorted(busy + [(p.start, p.end) for p in kept if p.strength == strength])
    return by_start(kept)


def scope_starts(text: str) -> list[int]:
    """Where scopes begin: at the start and at each blank line."""
    return [0, *(m.end() for m in _BLANK_LINE.finditer(text))] if "\n" in text else [0]


@dataclass(frozen=True)
class Partners:
    """For each secret the ranges of partners before it (first to before) and behind it (behind to last)."""

    first: np.ndarray
    before: np.ndarray
    behind: np.ndarray
    last: np.ndarray

    def any(self) -> np.ndarray:
        return (self.first < self.before) | (self.behind < self.last)

    def covered(self, of: np.ndarray, n: int) -> np.ndarray:
        """Which of the n others are partners of the secrets ``of``."""
        change = np.zeros(n + 1, np.int64)
        for low, high in ((self.first, self.before), (self.behind, self.last)):
            live = of & (low < high)
            np.add.at(change, low[live], 1)
            np.add.at(change, high[live], -1)
        return np.cumsum(change)[:n] > 0

    def nearest(self, start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
        """Number of the nearest partner, -1 for none."""
        far = np.iinfo(np.int64).max
        other_start, other_end = np.append(other_start, 0), np.append(other_end, 0)
        left = np.where(self.first < self.before, start - other_end[self.before - 1], far)
        right = np.where(self.behind < self.last, other_start[np.minimum(self.behind, len(other_start) - 1)] - end, far)
        return np.where(np.minimum(left, right) == far, -1, np.where(left <= right, self.before - 1, self.behind))


def interval_join(start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray, scopes: np.ndarray, reach: int) -> Partners:
    """Join intervals with others (sorted, apart) of the same scope within reach that do not overlap them.

    ``scopes`` are the places where scopes begin; no interval crosses one.
    """
    scope = np.searchsorted(scopes, start, "right")
    low = np.maximum(scopes[scope - 1], start - reach)
    high = np.minimum(np.append(scopes, np.iinfo(np.int64).max)[scope] - 1, end + reach)
    before = np.searchsorted(other_end, start, "right")
    behind = np.searchsorted(other_start, end, "left")
    inside = np.searchsorted(other_start, scopes[scope - 1], "left")  # others of the scope and of later ones
    return Partners(np.minimum(np.maximum(np.searchsorted(other_end, low, "left"), inside), before), before,
                    behind, np.maximum(np.searchsorted(other_start, high, "right"), behind))


def link(texts: list[list[Part]], scopes: list[list[int]], sizes: list[int], reach: int = REACH) -> tuple[list[list[Part]], list[list[tuple]]]:
    """The parts of each text that are reported, and its links (secret, identifier or None, endpoint or None)."""
    base = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])  # every text has places of its own
    begins = np.concatenate([np.array(s, np.int64) + b for s, b in zip(scopes, base)] or [np.zeros(0, np.int64)])
    flat = [(k, p) for k, found in enumerate(texts) for p in found]
    by_role = {role: [(k, p) for k, p in flat if p.role == role] for role in (IDENTIFIER, SECRET, ENDPOINT)}
    places = {role: tuple(np.array([base[k] + x for k, p in own for x in ((p.start, p.end)[side],)], np.int64) for side in (0, 1))
              for role, own in by_role.items()}
    strength = np.array([p.strength for _, p in by_role[SECRET]], np.int64)
    ids, ends = (interval_join(*places[SECRET], *places[role], begins, reach) for role in (IDENTIFIER, ENDPOINT))
    has_id, has_end = ids.any(), ends.any()
    shown = (strength == BASE) | has_id | (strength == NAMED) & has_end
    reported = {SECRET: shown, IDENTIFIER: ids.covered(shown, len(by_role[IDENTIFIER])),
                ENDPOINT: ends.covered(shown & has_id, len(by_role[ENDPOINT]))}
    out: list[list[Part]] = [[] for _ in texts]
    for role, own in by_role.items():
        for (k, part), yes in zip(own, reported[role].tolist()):
            if yes or part.strength == BASE:
                out[k].append(part)
    links: list[list[tuple]] = [[] for _ in texts]
    near_id = ids.nearest(*places[SECRET], *places[IDENTIFIER])
    near_end = ends.nearest(*places[SECRET], *places[ENDPOINT])
    for at in np.flatnonzero(shown & (has_id | has_end)).tolist():
        k, part = by_role[SECRET][at]
        links[k].append((part, *(by_role[role][n][1] if n >= 0 else None
                                 for role, n in ((IDENTIFIER, int(near_id[at])), (ENDPOINT, int(near_end[at]))))))
    return [by_start(found) for found in out], links


def _long_runs(column: pa.Array) -> np.ndarray:
    """Which texts have a run of signs long enough for a key."""
    data, offsets = utf8(column)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _RUN[data], [False]])))
    start, end = edge[::2], edge[1::2]  # a run may go on into the next text, which only costs a look
    long = end - start >= _LONG_RUN
    seen = np.zeros(len(data) + 1, np.int32)
    np.add.at(seen, start[long], 1)
    np.add.at(seen, end[long], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(seen)[:-1])])
    return np.diff(inside[offsets]) > 0


def find(column: pa.Array, reach: int = REACH) -> tuple[list[list[Part]], list[list[Part]], list[list[tuple]]]:
    """Spans of the base, all reported spans, and links of each text."""
    base, every, scopes, sizes = [], [], [], []
    for text, long_runs in zip(column.to_pylist(), _long_runs(column).tolist()):
        text = text or ""
        own = base_parts(text, long_runs)
        weak = weak_parts(text, own, long_runs)
        base.append(own)
        every.append(own + weak)
        scopes.append(scope_starts(text) if weak else [0])
        sizes.append(len(text))
    return base, *link([by_start(found) for found in every], scopes, sizes, reach)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_LINK = pa.struct([(name, _SPAN) for name in (SECRET, IDENTIFIER, ENDPOINT)])


def scan(docs: DataFrame, key: str = "doc_id", reach: int = REACH) -> DataFrame:
    """``key, base, spans, links`` of every whole text, in one pass without a shuffle.

    Spans are structs of ``kind, start, end``; links are structs of three spans, ``secret, identifier, endpoint``.
    """
    kind = docs.schema[key].dataType.simpleString()
    span = "struct<kind:string,start:long,end:long>"

    def row(part: Part | None) -> dict | None:
        return part and {"kind": part.kind, "start": part.start, "end": part.end}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            base, spans, links = find(piece.column(1), reach)
            yield pa.RecordBatch.from_arrays([
                piece.column(0),
                *(pa.array([[row(p) for p in found] for found in some], pa.list_(_SPAN)) for some in (base, spans)),
                pa.array([[dict(zip((SECRET, IDENTIFIER, ENDPOINT), map(row, parts))) for parts in found] for found in links], pa.list_(_LINK)),
            ], names=[key, "base", "spans", "links"])

    return docs.select(key, "text").mapInArrow(
        run, f"`{key}` {kind}, base array<{span}>, spans array<{span}>, links array<struct<secret:{span},identifier:{span},endpoint:{span}>>")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op11_multipart_credentials")
def op11_multipart_credentials(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"),
                        _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"),
                        F.size("links").cast("long").alias("n_links"))
