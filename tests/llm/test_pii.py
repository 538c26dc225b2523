"""Personal data against the plain patterns, and the validators and context of the further kinds."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from axisflow.llm.pii import BASE, KINDS, aba, base_spans, luhn, mod97, personal_data, redact, redacted, spans_of
from axisflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """The base kinds as the patterns say, without any short way."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if max(map(int, m.group().split("."))) <= 255]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns_on_drawn_texts():
    drawn = random.Random(11)
    parts = ["a", "@", ".", "b.c", "-", "%", "+", "1", "22", "255", "256", "007", " ", "(", ")", "\n", "é", "4111 1111 1111 1111", "4080250821787625", "x@y.z", "+1 (524) 555-7373", "10.0.0.1", "@@", "..",
             "4539-1488-0343-6467", "0" * 5, "٣", "a@b.co@d.ef", "1.2.3.4.5.6.7.8"]
    for _ in range(20_000):
        text = "".join(drawn.choice(parts) for _ in range(drawn.randint(0, 14)))
        assert base_spans(text) == plain(text), text


def test_base_spans_equal_the_plain_patterns_on_the_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op11_personal_data"](spark, SF).collect()}
    rows = duckdb.execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want = plain(text or "")
        said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        r = got[doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and x.split(":")[0] in BASE] == [x for x in said.split(",") if x]


def test_validators():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765433")
    assert aba("021000021") and not aba("021000022") and not aba("990000007")


def named(text, **kw):
    return [(KINDS[k], text[s:e]) for s, k, e, _ in spans_of(text, **kw)]


@pytest.mark.parametrize("text, want", [
    ("IBAN GB82 WEST 1234 5698 7654 32 OK", [("iban", "GB82 WEST 1234 5698 7654 32")]),
    ("see DE89370400440532013000.", [("iban", "DE89370400440532013000")]),
    ("see DE89370400440532013001.", []),                       # wrong check digits
    ("see DE893704004405320130001.", []),                      # too long for its country
    ("invoice sample DE89370400440532013000", []),             # words that speak against
    ("my social security number is 219-09-9999", [("ssn", "219-09-9999")]),
    ("the code 219-09-9999", []),                              # no context
    ("social security 666-09-9999", []),                       # never given out
    ("routing 021000021", [("routing", "021000021")]),
    ("number 021000021", []),
    ("Tel. (030) 1234 5678", [("tel", "(030) 1234 5678")]),
    ("call 555-0100 now", [("tel", "555-0100")]),
    ("page 555-0100 now", []),
    ("server fe80::1ff:fe23:4567:890a up", [("ipv6", "fe80::1ff:fe23:4567:890a")]),
    ("std::dead::beef", []),
    ("phone +49 30 123456 78", [("phone", "+49 30 123456 78")]),  # base spans keep their room
    ("mail me: a.b+c@x-y.example.org.", [("email", "a.b+c@x-y.example.org")]),
])
def test_kinds_and_context(text, want):
    assert named(text) == want


def test_threshold_is_a_parameter():
    assert named("number 219-09-9999", threshold=0.3) == [("ssn", "219-09-9999")]
    assert named("version 10.0.0.1", threshold=0.99) == [("ip", "10.0.0.1")]  # base spans stay


def test_redaction():
    text = "a@b.org calls +1 (524) 555-7373, 10.0.0.1"
    assert redacted(text, spans_of(text)) == "[email] calls [phone], [ip]"
    assert redacted(None, []) is None


def test_odd_rows_and_clashing_columns(spark):
    long = "a" * 300_000 + " " + "1" * 300_000 + " x@y.org " + "@" * 100_000 + "+1" * 50_000
    docs = [(1, None), (2, ""), (2, ""), (None, "x@y.org"), (3, long)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("SPANS", F.lit("clash")).withColumn("n_ip", F.lit(1))
    got = personal_data(df)
    assert got.columns == ["doc_id", "text", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans", "scores"]
    rows = {(r.doc_id, r.spans, r.n_email, r.n_ip) for r in got.collect()}
    empty = (1, "", 0, 0)
    assert {empty, (2, "", 0, 0), (None, "email:0:7", 1, 0), (3, "email:600002:600009", 1, 0)} == rows
    assert got.count() == 5 and got.where("spans = ''").select("base_sha256").distinct().collect()[0][0] == hashlib.sha256(b"").hexdigest()
    assert personal_data(df.limit(0)).count() == 0
    assert {r.text for r in redact(df.where("doc_id is null or doc_id = 1")).collect()} == {None, "[email]"}
