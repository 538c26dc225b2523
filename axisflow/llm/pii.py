"""Personal data in texts: patterns propose spans, checksums confirm them, context words near by adjust a score."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import put

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "routing", "tel", "ipv6")
BASE = KINDS[:4]
THRESHOLD = 0.6   # score from which a span of a kind beyond the base is reported
BEFORE, AFTER = 48, 16  # code points of context on either side

#: Score of a confirmed span before its context is read. Kinds below the threshold need a context word.
PRIOR = {"email": 0.85, "ip": 0.65, "card": 0.8, "phone": 0.7, "iban": 0.75, "ssn": 0.4, "routing": 0.4, "tel": 0.4, "ipv6": 0.4}
STEP = 0.25       # what a context word adds or takes

#: Words that speak for a kind, lower case, in the languages of the corpus.
FOR = {
    "email": {"email", "mail", "contact", "write", "correo", "courriel", "kontakt"},
    "ip": {"ip", "address", "host", "server", "client", "login", "adresse", "dirección"},
    "card": {"card", "credit", "debit", "visa", "mastercard", "amex", "payment", "karte", "kreditkarte", "tarjeta", "carte"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "handy", "teléfono", "móvil", "téléphone", "portable"},
    "iban": {"iban", "account", "bank", "transfer", "konto", "cuenta", "compte", "virement"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "routing": {"routing", "aba", "rtn", "transit"},
    "ipv6": {"ip", "ipv6", "address", "host", "server", "adresse"},
}
FOR["tel"] = FOR["phone"]

#: Words that speak against any kind.
AGAINST = {"version", "isbn", "issn", "order", "invoice", "serial", "part", "model", "sku", "doi", "rfc", "example", "sample", "bestellung", "rechnung", "factura", "facture", "commande", "pedido"}

#: Lengths of account numbers by country, as published in the registry of ISO 13616.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # no other start inside a run of digits can match, so runs are read once
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")      # shorter chains have too few digits
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
ROUTING = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-])")
TEL = re.compile(r"(?<![0-9A-Za-z+./-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7})[0-9A-Fa-f:]{5,39}(?![0-9A-Za-z:])")
DIGITS = re.compile(r"[0-9]")
CONTEXT = re.compile(r"[^\W\d_]+")
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)  # digit sums of doubled digits

Span = tuple[int, int, int, float]  # start, rank of the kind, end, score


def digits_of(s: str) -> str:
    return "".join(DIGITS.findall(s))


def luhn(digits: str) -> bool:
    """Doubling every second digit from the right, digit sums add up to a multiple of ten."""
    total = sum(int(c) for c in digits[-1::-2]) + sum(DOUBLED[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The first four characters moved to the end, letters as two digits, leave 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def aba(digits: str) -> bool:
    """Weights 3, 7, 1 give a multiple of ten; the first two digits name a district."""
    lead = int(digits[:2])
    return sum(int(c) * w for c, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0 and (1 <= lead <= 12 or 21 <= lead <= 32 or 61 <= lead <= 72 or lead == 80)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of name, sign and dotted domain. Each run of name characters is read once, so long runs cost no more."""
    at, free = text.find("@"), 0
    while at >= 0:
        name = text[free:at]
        start = free + len(name.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the four base kinds, leftmost and non-overlapping per kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = digits_of(m.group()) if m.end() - m.start() <= 37 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(found)


def _account_end(text: str, start: int, end: int) -> int | None:
    """Where an account number of its country's length ends, if its check digits hold."""
    need, at, chars = IBAN_LENGTHS.get(text[start:start + 2], 0), start, []
    while at < end and len(chars) < need:
        if text[at] not in " -":
            chars.append(text[at])
        at += 1
    whole = need and len(chars) == need and not (at < len(text) and text[at].isalnum())
    return at if whole and mod97("".join(chars)) else None


def _ipv6(s: str) -> bool:
    try:
        return ipaddress.IPv6Address(s).compressed.count(":") >= 2 and len(s) >= 6
    except ValueError:
        return False


def proposed(text: str) -> Iterator[tuple[int, str, int]]:
    """Spans of the further kinds that their validators confirm."""
    for m in IBAN.finditer(text):
        end = _account_end(text, m.start(), m.end())
        if end is not None:
            yield m.start(), "iban", end
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.start(), "ssn", m.end()
    for m in ROUTING.finditer(text):
        if aba(m.group()):
            yield m.start(), "routing", m.end()
    for m in TEL.finditer(text):
        if 7 <= len(digits_of(m.group())) <= 15:
            yield m.start(), "tel", m.end()
    if ":" in text:
        for m in IPV6.finditer(text):
            if _ipv6(m.group()):
                yield m.start(), "ipv6", m.end()


def score_of(text: str, start: int, kind: str, end: int) -> float:
    """The kind's prior, raised by a context word of the kind and lowered by one that speaks against."""
    near = set(CONTEXT.findall(text[max(0, start - BEFORE):start].lower())) | set(CONTEXT.findall(text[end:end + AFTER].lower()))
    return min(1.0, max(0.0, PRIOR[kind] + STEP * (not near.isdisjoint(FOR[kind])) - STEP * (not near.isdisjoint(AGAINST))))


def spans_of(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text by start and kind. Base spans stay whatever they score; others need the threshold and free room."""
    text = text or ""
    base = base_spans(text)
    starts = [s for s, _, _ in base]
    reach: list[int] = []  # greatest end up to each base span; kinds may overlap each other
    for _, _, e in base:
        reach.append(max(e, reach[-1]) if reach else e)
    more: list[Span] = []
    for s, kind, e in sorted(proposed(text)):
        i = bisect_right(starts, e - 1)
        if i and reach[i - 1] > s:
            continue
        score = score_of(text, s, kind, e)
        if score < threshold:
            continue
        if more and more[-1][2] > s:
            if score > more[-1][3]:
                more[-1] = (s, KINDS.index(kind), e, score)
        else:
            more.append((s, KINDS.index(kind), e, score))
    return sorted([(s, k, e, score_of(text, s, KINDS[k], e)) for s, k, e in base] + more)


def redacted(text: str | None, spans: list[Span], least: float = 0.0) -> str | None:
    """The text with every span of at least that score replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, done = [], 0
    for s, k, e, score in spans:
        if score < least:
            continue
        if s >= done:
            out += [text[done:s], f"[{KINDS[k]}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


SCHEMA = ", ".join(f"n_{k} long" for k in BASE) + ", n_added long, base_sha256 string, spans string, scores string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def row_of(text: str | None, threshold: float) -> tuple:
    spans = spans_of(text, threshold)
    base = [x for x in spans if x[1] < len(BASE)]
    said = lambda some: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in some)
    n = [sum(x[1] == i for x in base) for i in range(len(BASE))]
    return (*n, len(spans) - len(base), hashlib.sha256(said(base).encode()).hexdigest(), said(spans), ",".join(f"{x[3]:.2f}" for x in spans))


def _scan(text: Column, threshold: float) -> Column:
    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([row_of(x, threshold) for x in texts], columns=NAMES)
    return run(text)


def personal_data(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans and scores.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) by start, ``scores`` their scores in that order.
    Account numbers must have their country's length and pass mod-97, cards Luhn, routing numbers their weights; local
    telephone, social security and routing numbers also need a context word. Every text is read whole in its own row;
    nothing is shuffled.

    A null text is empty and has no spans. Repeated rows are scanned one by one, columns
    with the new names give way, an empty table gives an empty table.
    """
    text = F.col(f"`{next(c for c in docs.columns if c.lower() == text_col.lower())}`")
    order = [c for c in docs.columns if c.lower() not in NAMES]
    found = docs.withColumn("_personal_data", _scan(text, threshold))
    return put(found, **{n: F.col(f"_personal_data.{n}") for n in NAMES}).select(*[F.col(f"`{c}`") for c in order], *NAMES)


def redact(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, least: float = 0.0) -> DataFrame:
    """``docs`` with every span that scores ``least`` or more replaced by its kind in brackets; a null text stays null."""
    text = next(c for c in docs.columns if c.lower() == text_col.lower())

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([redacted(x, spans_of(x, threshold), least) for x in texts], dtype=object)
    return docs.withColumn(text, run(F.col(f"`{text}`")))
