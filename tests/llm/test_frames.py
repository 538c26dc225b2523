"""Fill-in-middle: frames, cuts and round trips against plain string operations and SQL."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from axisflow.llm import frames
from axisflow.llm.frames import Frames, fill_in_middle, frame_store, part_ranges, rearranged, restored
from axisflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    x = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return n, "psm", a, b - a, sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@pytest.mark.parametrize("units", [1, 2, 3, 7, 1000])
def test_frames_cut_and_restore(units):
    drawn = random.Random(units)
    for _ in range(200):
        text = "".join(drawn.choice("ab<>PSM é😀\n\x00") for _ in range(drawn.randint(0, 30)))
        if any(m in text for m in frames.MARKERS):
            continue
        a, b = sorted(drawn.randint(0, len(text)) for _ in range(2))
        kept = Frames.of(text, units)
        assert kept.n == len(text) and "".join(kept.stream()) == text and "".join(kept.stream(a, b)) == text[a:b]
        for form, out in (("psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), ("spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")):
            made = rearranged(kept, form, a, b)
            assert "".join(made.stream()) == out
            assert {p: out[slice(*r)] for p, r in part_ranges(made, form).items()} == {"P": text[:a], "M": text[a:b], "S": text[b:]}
            assert restored(made, form) == sha(text)
            # the markers are found in whatever frames the output lies, also across their ends
            assert restored(Frames.of(out, units), form) == sha(text)


def test_only_cut_frames_are_opened(monkeypatch):
    kept, opened = Frames.of("x" * 1000, 100), []
    was = Frames.text
    monkeypatch.setattr(Frames, "text", lambda self, i: opened.append(i) or was(self, i))
    rearranged(kept, "psm", 250, 600)
    assert sorted(opened) == [2, 2]  # 600 is the end of a frame


DOCS = [(1, None), (2, ""), (2, ""), (3, "a"), (4, "<P>"), (5, "x<S>y"), (None, "no id, é😀"), (6, "long é " * 40_000), (7, "same"), (7, "same"), (7, "other length")] + [(i, f"text {i} " * (i % 9)) for i in range(10, 300)]


@pytest.mark.parametrize("units", [5_000, frames.UNITS])
def test_rows_equal_the_plain_version(spark, units):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("FORM", F.lit("clash")).withColumn("frames", F.lit(1)).withColumn("n", F.lit("clash"))
    got = fill_in_middle(frame_store(df, units=units))
    assert got.columns == ["doc_id", "n", "marked", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "unit_ends", "byte_ends", "frames"]
    want = sorted(((i, *plain(i, t)) for i, t in DOCS), key=repr)
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in got.collect()), key=repr) == want
    assert fill_in_middle(frame_store(df.limit(0))).count() == 0
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_query_equals_sql(spark):
    got = QUERIES["op12_fill_in_middle"](spark, SF)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = con.execute(ORACLES["op12_fill_in_middle"])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cur.fetchall())
