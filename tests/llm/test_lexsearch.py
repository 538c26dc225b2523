"""Ranked search against a plain scorer and SQL; blocks are skipped without changing a result."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axisflow.llm import lexsearch
from axisflow.llm.lexsearch import Best, build, impact, ranked_search, search_segment, terms_of
from axisflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counted = [(i, Counter(words(t))) for i, t in docs]
    docs_n, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            n, score = sum(c.values()), 0
            for t in set(words(text)) & c.keys():
                m = 100 - 90 + (90 * n * docs_n) // length
                score += math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def drawn_docs(n, seed=13, vocabulary=60):
    drawn = random.Random(seed)
    some = lambda: "w" + str(int(drawn.paretovariate(0.7)) % vocabulary)
    return [(i, " ".join(some() for _ in range(drawn.choice([3, 10, 40, 200])))) for i in range(n)]


def test_terms():
    assert [t.decode() for t in terms_of("Ab-ÀB 9\x7f٣x_y's　z\n")] == words("Ab-ÀB 9\x7f٣x_y's　z\n") == ["ab", "Àb", "9", "٣x", "y", "s　z"]
    assert terms_of(None) == terms_of("") == terms_of(" -_") == []


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lexsearch, "SHORT", 4)
    monkeypatch.setattr(lexsearch, "BLOCK", 8)
    monkeypatch.setattr(lexsearch, "CENTRES", 16)


def segment_of(docs, keep=None):
    counts = [Counter(words(t)) for _, t in docs]
    n, length = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    keys = [sorted(c) for c in counts]
    seg = build(np.array([i for i, _ in docs]), np.zeros(len(docs), bool), np.array([sum(c.values()) for c in counts]), pa.array([t for k in keys for t in k], pa.string()),
                np.array([c[t] for k, c in zip(keys, counts) for t in k]), np.array([len(k) for k in keys]), n, length)
    return seg, counts, n, length


def test_summaries_are_exact_maxima(small_blocks):
    docs = drawn_docs(200)
    seg, counts, n, length = segment_of(docs)
    for t, name in enumerate(seg.terms):
        listed = [d for b in range(seg.list_blocks[t], seg.list_blocks[t + 1]) for d in seg.block_docs[seg.block_ptr[b]:seg.block_ptr[b + 1]]]
        assert sorted(listed) == [d for d, c in enumerate(counts) if name in c]  # every posting lies in one block
        for b in range(seg.list_blocks[t], seg.list_blocks[t + 1]):
            inside = seg.block_docs[seg.block_ptr[b]:seg.block_ptr[b + 1]]
            want = {}
            for d in inside:
                for w, tf in counts[d].items():
                    want[w] = max(want.get(w, 0), impact(tf, sum(counts[d].values()), n, length))
            assert seg.block_max[b] == want[name] and len(inside) <= max(lexsearch.SHORT, lexsearch.BLOCK)
            held = slice(seg.sum_ptr[b], seg.sum_ptr[b + 1])
            if len(listed) > lexsearch.SHORT:
                assert {seg.terms[c]: m for c, m in zip(seg.sum_cols[held], seg.sum_max[held])} == want
            else:
                assert seg.sum_ptr[b] == seg.sum_ptr[b + 1]


def test_blocks_are_skipped_and_results_stay(small_blocks):
    docs = drawn_docs(600, vocabulary=150)
    seg, counts, n, length = segment_of(docs)
    df = Counter(t for c in counts for t in c)
    seen = Counter()
    for item, text in drawn_docs(40, seed=5, vocabulary=150):
        query = [(t, math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t in set(words(text)) if df[t]]
        best = Best(10)
        search_segment(seg, query, best, seen)
        assert sorted((0, r, -i, s) for r, (s, _, i) in enumerate(sorted(best.heap, reverse=True), 1)) == sorted(plain(docs, [(0, text)]))
    assert seen["skipped"] > 0 and seen["scored"] < 40 * len(docs)


ODD = [(1, None), (2, ""), (3, "-- _"), (4, "Apple pear"), (4, "Apple pear"), (None, "apple pear"), (None, "apple"), (5, "apple " * 200_000 + "plum"), (6, "pear plum"), (7, "x" * 300_000)] + [(100 + i, "the apple") for i in range(30)]
ITEMS = [(1, "apple"), (2, "PLUM pear pear"), (3, None), (4, ""), (5, "unknown"), (6, "the"), (7, "x" * 300_000), (8, "apple pear plum the"), (8, "pear")]


@pytest.mark.parametrize("limited", [True, False])
def test_odd_rows_ties_and_clashing_columns(spark, monkeypatch, limited):
    if not limited:
        monkeypatch.setattr(lexsearch, "VOCABULARY", 0)   # every term is indexed
        monkeypatch.setattr(lexsearch, "QUERY_BLOCK", 4)  # queries pass in blocks
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("terms", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = ranked_search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(ODD, ITEMS)
    assert ranked_search(docs.limit(0), items).count() == 0 and ranked_search(docs, items.limit(0)).count() == 0


def test_many_segments_equal_the_plain_scorer(spark, monkeypatch, small_blocks):
    monkeypatch.setattr(lexsearch, "SEGMENT_DOCS", 37)
    monkeypatch.setattr(lexsearch, "SEGMENT_POSTINGS", 500)
    docs, items = drawn_docs(900, vocabulary=80), drawn_docs(25, seed=3, vocabulary=80)
    got = ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, items)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES["op13_ranked_search"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op13_ranked_search"](spark, SF).collect()) == sorted(want)
