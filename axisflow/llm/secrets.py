"""Secrets in texts: sure patterns, and weak ones that count only beside their complementary parts."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import put

KINDS = ("assign", "access", "hex", "identifier", "weak", "endpoint")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(user(?:_?name|_?id)?|login|account|client_?id|access_?key_?id|tenant)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.I | re.A)
WEAK = re.compile(r"""(?<![A-Za-z0-9])(pwd|pass(?:word|wd|phrase)?|secret|token|credentials?|auth|private_?key|access_?key|api_?key|key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{4,})"""
                  r"""|(?<![A-Za-z0-9+/=])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=])""", re.I | re.A)
ENDPOINT = re.compile(r"""(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}|(?<![A-Za-z0-9])(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]{1,5})?""", re.I | re.A)
BLANK = re.compile(r"\n[\x20\x09\x0d]*\n")

Span = tuple[int, int, int]  # start, rank of the kind, end


def base_spans(text: str) -> list[Span]:
    """Sure secrets, leftmost and non-overlapping per kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _mixed(s: str) -> bool:
    """A bare run of 40 looks like a key only if it mixes cases and digits."""
    return any(c.islower() for c in s) and any(c.isupper() for c in s) and any(c.isdigit() for c in s)


def _within_reach(others: list[tuple[int, int]], scope, reach: int | None):
    """Whether any of ``others`` is in a part's scope, and within ``reach`` code points of it if that is given, as a function of the part."""
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}  # greatest end up to each start
    for s, e in sorted(others):
        at = scope(s)
        starts.setdefault(at, []).append(s)
        upto = ends.setdefault(at, [])
        upto.append(max(e, upto[-1]) if upto else e)

    def near(part: tuple[int, int]) -> bool:
        at = scope(part[0])
        if reach is None:
            return at in starts
        n = bisect_right(starts.get(at, ()), part[1] + reach)
        return n > 0 and ends[at][n - 1] >= part[0] - reach
    return near


def linked_spans(text: str, base: list[Span], reach: int | None = None) -> list[Span]:
    """Parts of multipart credentials: an identifier or endpoint beside a secret, and a weak secret beside either.

    Intervals of the three part kinds meet by position inside a scope (text between blank lines). Every part asks whether
    any complementary part is in its scope, so all partners count and a text with many parts never forms all pairs.
    """
    low = text.lower()
    if ":" not in text and "=" not in text and "AKIA" not in text:  # without a sign only an access key can have a partner
        return []
    starts, upto = [], []  # base spans may lie inside each other, so the greatest end so far decides
    for s, _, e in base:
        starts.append(s)
        upto.append(max(e, upto[-1]) if upto else e)

    def free(s: int, e: int) -> bool:
        before = bisect_left(starts, e)
        return not before or upto[before - 1] <= s
    ids = [(m.start(), m.end()) for m in IDENTIFIER.finditer(text)] if any(w in low for w in ("user", "login", "account", "client", "access", "tenant")) else []
    ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)] if any(w in low for w in ("://", "host", "endpoint", "server")) else []
    ids = [p for p in ids if free(*p)]
    sure_ids = ids + [(s, e) for s, k, e in base if k == 1]
    if not sure_ids and not ends:
        return []
    weak = [(m.start(), m.end()) for m in WEAK.finditer(text) if m.group(3) is None or _mixed(m.group(3))]
    weak = [p for p in weak if free(*p) and p not in ids]
    secret = weak + [(s, e) for s, k, e in base if k != 1]
    blanks = [m.start() for m in BLANK.finditer(text)]
    scope = lambda at: bisect_left(blanks, at)
    near_partner, near_secret = _within_reach(sure_ids + ends, scope, reach), _within_reach(secret, scope, reach)
    found = {(s, 4, e) for s, e in weak if near_partner((s, e))}
    found |= {(s, 3, e) for s, e in ids if near_secret((s, e))}
    found |= {(s, 5, e) for s, e in ends if near_secret((s, e))}
    return sorted(found)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string"


def secrets_of(text: str | None, reach: int | None = None) -> tuple:
    text = text or ""
    base = base_spans(text)
    more = linked_spans(text, base, reach)
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*n, len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more)))


def scan(text: Column, reach: int | None) -> Column:
    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([secrets_of(x, reach) for x in texts], columns=["n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"])
    return run(text)


def secret_scan(docs: DataFrame, text_col: str = "text", reach: int | None = None) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_linked, base_sha256 and spans (``kind:start:end``, code points, end exclusive).

    Base kinds are found on their own. Identifiers, endpoints and weak secrets are reported only where parts that
    complement each other stand in one scope, the text between blank lines; with ``reach`` they must also lie within
    so many code points of each other. Parts of a credential lie in one text, so
    the join happens beside the text and nothing is shuffled.

    A null text is empty and has no spans. Repeated rows are scanned one by one, columns with the new names give way,
    an empty table gives an empty table.
    """
    text = F.col(f"`{next(c for c in docs.columns if c.lower() == text_col.lower())}`")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    with_found = docs.withColumn("_secret_scan", scan(text, reach))
    order = [c for c in docs.columns if c.lower() not in names]
    return put(with_found, **{n: F.col(f"_secret_scan.{n}") for n in names}).select(*[F.col(f"`{c}`") for c in order], *names)
