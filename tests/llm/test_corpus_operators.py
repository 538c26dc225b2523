"""Quality classifier, token counts, similarity join, packing and the pipeline against plain versions."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from axisflow.llm import linededup, packing
from axisflow.llm.ngramjoin import SignatureTree, bitmap, bits_for, drop_similar, fold, prefix_size, similar_components
from axisflow.llm.packing import fractional_plan, integer_plan, pack
from axisflow.llm.quality import fit_hinge, quality_classifier
from axisflow.llm.tokens import Encoder, PieceCache, token_counts
from axisflow.llm.wordhash import per_text, shingles

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"
VOCAB = "word_bpe_49k.json"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- word hashes

def test_word_hashes_follow_the_words(monkeypatch):
    import pyarrow as pa

    from axisflow.llm import wordhash
    texts = ["The cat\tsat", None, "", "  ", "the CAT sat \x0b", "É é", "a" * 300 + " b", "x y " * 200, "cat"]
    whole = [h.tolist() for h in per_text(pa.array(texts))]
    assert [len(h) for h in whole] == [len(words(t)) for t in texts]
    assert whole[0] == whole[4] and whole[0][1] == whole[8][0] and whole[5][0] != whole[5][1]
    monkeypatch.setattr(wordhash, "SLICE", 64)
    assert [h.tolist() for h in per_text(pa.array(texts))] == whole
    assert [h.tolist() for h in per_text(pa.array(["zz", *texts]).slice(1))] == whole
    assert len(shingles(np.array(whole[0], np.uint64), 3)) == 1 == len(shingles(np.array(whole[8], np.uint64), 3))


def test_hashing_holds_little_at_once():
    import tracemalloc

    import pyarrow as pa
    texts = pa.array([("w" * 99 + " ") * 5000] * 8)
    tracemalloc.start()
    assert [len(h) for h in per_text(texts)] == [5000] * 8
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000


# ---------------------------------------------------------------- quality classifier

def test_hinge_separates():
    rng = np.random.default_rng(0)
    label = np.arange(200) % 2
    rows = [np.unique(np.concatenate([rng.integers(2, 50, 5), [y]])) for y in label]
    ratio = np.ones(50)
    ratio[0] = -1
    weight, bias = fit_hinge(rows, label, ratio)
    assert all((weight[r] @ ratio[r] + bias > 0) == bool(y) for r, y in zip(rows, label))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier(docs.withColumn("Score", F.lit("clash")), labels)
    judged = got.join(labels, "doc_id").where("held_out").toPandas()
    assert len(judged) > 80 and (judged.predicted == judged.quality).mean() > 0.97
    ids = got.select("doc_id", "held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in ids)
    assert got.where("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0


def test_fit_gives_its_memory_back(spark):
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    before = held()
    quality_classifier(docs, labels)
    assert held() - before < 25


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some words"), (4, "x " * 100_000), (4, "y")], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (4, 7), (4, 1), (4, 1)], "doc_id long, quality int")
    got = quality_classifier(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier(docs.where("false"), labels).collect() == []
    assert {r.score for r in quality_classifier(docs, labels.where("false")).collect()} == {0.5}


# ---------------------------------------------------------------- tokens

ODD = [None, "", " ", "Hello, WORLD!!  it's\n\n1234 <|endoftext|>x <|startoftext|>", "a\x1cb c d é ́x İstanbul ΣΑΣ ﬁ Å ½ ² Ⅳ", "don't we're I'll ''s 's", "tab\there\r\nvt\x0bff\x0c",
       "日本語 テキスト 한국어 🙂🙂!", "w" * 5000, "word. word, (word) -word- #tag $5 50% a_b c-d e.g.", "ÉÉÉ Öl ẞ ß", "​zero﻿ width"]


@pytest.mark.parametrize("by_piece", [True, False])
def test_counts_are_the_librarys(spark, by_piece):
    encode = Encoder.of(VOCAB).ids
    docs = spark.createDataFrame(list(enumerate(ODD * 2)), DOCS).withColumn("n_Bytes", F.lit("clash"))
    got = token_counts(docs, limit=10, by_piece=by_piece, frequent=50)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    for r in got.collect():
        n = len(encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 10), repr(r.text)
    assert token_counts(docs.where("false")).collect() == []


def test_whole_table_counts(spark):
    encode = Encoder.of(VOCAB).ids
    for r in token_counts(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert r.n_tokens == len(encode(r.text or ""))


def test_piece_cache_stays_exact_when_full(monkeypatch):
    from axisflow.llm import tokens
    monkeypatch.setattr(tokens, "CACHE", 3)
    encode = Encoder.of(VOCAB).ids
    cache = PieceCache(lambda t: len(encode(t)))
    for t in ["one", "two,", "three!", "four", "it's", "five.", "one", "x²", ""] * 2:
        assert cache[t.encode()] == len(encode(t))


def test_plain_runs_go_to_the_model_alone(monkeypatch):
    from axisflow.llm import tokens
    encoder = Encoder.of(VOCAB)
    whole = []
    monkeypatch.setattr(encoder, "ids", lambda text, ids=encoder.ids: whole.append(text) or ids(text))
    monkeypatch.setattr(tokens, "worker_cache", lambda owner, held={}: held)
    text = "Invented wordings, thntored ofreblehehe " + " ".join(a + b for a in "abcdefgh" for b in ("s", "t", "zq", "thntored" * 9))
    for t in [text, *(x for x in ODD if x)]:
        got = np.frombuffer(tokens.id_bytes(VOCAB)(t), "<u4").tolist()
        if t is text:
            assert [w for w in whole if w.isalpha()] == []
        assert got == Encoder(VOCAB).ids(t), repr(t)


# ---------------------------------------------------------------- similarity join

def plain_components(docs, size, percent):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, text in docs:
        w = words((text or "").translate(lower))
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            holders[t].append(i)
    for i, s in enumerate(sets):
        for j in {j for t in s for j in holders[t] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(docs, sets))), key=repr)


def family(seed, n, length, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, length)]
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, length, rng.integers(0, edits + 1)):
            own[at] = f"e{rng.integers(0, 10**9)}"
        yield " ".join(own)


@pytest.fixture(scope="module")
def families():
    texts = [t for s, (n, length, edits) in enumerate([(60, 80, 3), (25, 300, 12), (10, 30, 1), (8, 1500, 40), (40, 12, 1)]) for t in family(s, n, length, edits)]
    texts += texts[::7] + ["", None, " \n", "one", "One", "one two", "two one", "same boiler plate line here " * 3] * 2
    texts += [f"head{i} a b c d e f g h i j k l m n o p" for i in range(60)]
    docs = [(int(i), t) for i, t in zip(np.random.default_rng(3).permutation(len(texts)), texts)]
    return docs + [docs[0], (docs[5][0], docs[90][1]), (None, docs[3][1]), (None, "only me without an id"), (None, "")]


@pytest.mark.parametrize("group, cluster", [(1024, 1500), (8, 7)])
def test_components_match_plain_version(spark, families, group, cluster):
    docs = spark.createDataFrame(families, DOCS).withColumn("class", F.lit(1)).repartition(5)
    got = similar_components(docs, group=group, cluster=cluster)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_components(families, 3, 90)


def test_other_sizes_and_empty(spark, families):
    docs = spark.createDataFrame(families, DOCS)
    got = similar_components(docs, size=5, percent=80, group=16, cluster=9)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_components(families, 5, 80)
    assert similar_components(docs.where("false")).collect() == []
    few = spark.createDataFrame([(1, None), (2, "a"), (3, "a b c d")], DOCS)
    assert sorted(map(tuple, similar_components(few).collect())) == [(1, 0, 1), (2, 1, 2), (3, 2, 3)]


def test_a_class_of_many_tasks_takes_one_place_in_its_group(spark):
    import pyarrow as pa

    import xxhash
    names = [f"w{i}" for i in range(400)]
    names.sort(key=lambda w: shingles(next(iter(per_text(pa.array([w])))), 1)[0])
    least, rest = names[0], names[1:]
    known = lambda ws: xxhash.xxh3_64_intdigest(np.unique(shingles(next(iter(per_text(pa.array([" ".join(ws)])))), 1)).tobytes()) - (1 << 63)
    a = [least, *rest[:8]]
    hot = next(h for h in ([least, *rest[20 + 8 * i:28 + 8 * i]] for i in range(40)) if known(h) > known(a))
    docs = [(1, " ".join(a)), (2, " ".join([*a, rest[15]])), *((10 + i, " ".join(hot)) for i in range(12))]
    df = spark.sparkContext.parallelize(docs, len(docs)).toDF(DOCS)  # a task for each text
    got = {r.doc_id: r.component_id for r in similar_components(df, size=1, percent=90, group=2).collect()}
    assert got == {1: 1, 2: 1, **{10 + i: 10 for i in range(12)}}


def test_one_of_each_group_stays(spark, families):
    docs = spark.createDataFrame(families, DOCS).withColumn("_n", F.lit("mine"))
    kept = drop_similar(docs)
    want = plain_components(families, 3, 90)
    ids = {d for d, n, c in want if d is not None and d == c}
    got = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in got} - {None} == ids and {r["_n"] for r in got} == {"mine"}
    assert drop_similar(docs.where("false")).collect() == []


def test_null_and_repeated_ids_lose_only_copies(spark):
    text = lambda i: " ".join(f"t{i}w{j}" for j in range(30))
    docs = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(1) + " end"), (1, text(2)), (1, text(3)), (1, text(3) + " end"), (2, text(4)), (3, text(4)), (3, text(5)), (3, text(5)), (None, text(5)), (None, None)]
    got = [(r.doc_id, r.text) for r in drop_similar(spark.createDataFrame(docs, DOCS)).collect()]
    assert len(got) == 7 and (None, None) in got and (None, text(0)) in got
    assert {i for i, x in got if x and x.startswith("t1w0")} == {None} and {i for i, x in got if x and x.startswith("t3w0")} == {1}
    assert {(1, text(2)), (2, text(4)), (3, text(5))} <= set(got)


def test_unrelated_sets_are_no_candidates():
    rng = np.random.default_rng(8)
    for n in (255, 511, 1023):  # signatures were weakest just below a power of two
        sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(40)]
        tree = SignatureTree([len(s) for s in sets], [int.from_bytes(bitmap(s, bits_for(len(s))), "little") for s in sets], [bits_for(len(s)) for s in sets], 80)
        assert list(tree.join()) == []


def test_what_only_shares_a_shingle_is_not_gathered(spark, monkeypatch):
    import pyarrow as pa

    from axisflow.llm import ngramjoin
    met, checked = [], []
    meet, check = ngramjoin._meet, ngramjoin._check
    monkeypatch.setattr(ngramjoin, "_meet", lambda signs, dealt, percent: met.append(dealt.count()) or meet(signs, dealt, percent))
    monkeypatch.setattr(ngramjoin, "_check", lambda docs, dealt, *a: checked.append({r[0] for r in dealt.select("doc_id").collect()}) or check(docs, dealt, *a))
    names = sorted((f"w{i}" for i in range(2000)), key=lambda w: shingles(next(iter(per_text(pa.array([w])))), 1)[0])
    least, rest = names[0], names[1:]  # a shingle of every prefix, in too few texts to be a common one
    texts = [[least, *rest[25 * i:25 * i + 24]] for i in range(6)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, " ".join([*texts[3], "end"]))]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(docs, DOCS), size=1, percent=80, group=2).collect()}
    assert got == {**{i: i for i in range(6)}, 900: 3}
    assert checked == [{3, 900}] and len(met) == 2  # the blocks, and what they leave apart
    met.clear(), checked.clear()
    pairs = [(10 * i + j, " ".join([*rest[30 * i:30 * i + 30], *["end"] * j])) for i in range(20) for j in range(2)]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(pairs, DOCS), size=1, percent=80).collect()}
    assert got == {10 * i + j: 10 * i for i in range(20) for j in range(2)}
    assert len(met) == 1 and met[0] <= 80  # a pair has up to seven shingles in common prefixes


def test_tree_never_prunes_a_similar_pair():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        base = np.unique(rng.integers(0, 2**63, rng.integers(5, 600), dtype=np.uint64))
        sets += [base, np.unique(np.concatenate([base[: len(base) - len(base) // 25], rng.integers(0, 2**63, len(base) // 30, dtype=np.uint64)]))]
    sets.sort(key=len)
    bits = [bits_for(len(s)) for s in sets]
    tree = SignatureTree([len(s) for s in sets], [int.from_bytes(bitmap(s, b), "little") for s, b in zip(sets, bits)], bits, 90)
    seen = {tuple(sorted(p)) for p in tree.join()}
    similar = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
               if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    assert similar and similar <= seen and len(seen) < len(sets) ** 2 / 8
    assert fold(0b10010110, 8, 4) == 0b1111 and prefix_size(9, 90) == 1 and prefix_size(10, 90) == 2 and prefix_size(1, 90) == 1


# ---------------------------------------------------------------- packing

def test_plans_hold_every_item():
    rng = np.random.default_rng(2)
    for top, n in ((64, 5000), (64, 40), (16, 3), (256, 100_000)):
        demand = np.bincount(rng.integers(0, top, n) * rng.integers(1, 9, n) // 8, minlength=top)
        plan = integer_plan(demand)
        assert (sum(p * c for p, c in plan) == demand).all() and all((p * np.arange(1, top + 1)).sum() <= top for p, _ in plan)
        low = (np.arange(1, top + 1) * demand).sum() / top
        assert sum(c for _, c in plan) <= max(low * 1.02 + 2, demand[top // 2:].sum())
    assert integer_plan(np.zeros(8, np.int64)) == [] and fractional_plan(np.zeros(8, np.int64))[0] == []


def check_pieces(got, docs, capacity, end):
    encode = Encoder.of(VOCAB).ids
    want = sorted([(d, np.array([*encode(t or ""), *end], "<u4")) for d, t in docs], key=lambda x: (x[0] is None, x[0] or 0, x[1].tobytes()))
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
    for (doc, total), own in pieces.items():
        texts = [ids for d, ids in want if d == doc and len(ids) == total]
        crcs = sorted((s, zlib.crc32(ids[s:s + capacity].tobytes()), len(ids[s:s + capacity])) for ids in texts for s in range(0, total, capacity))
        assert sorted((r.start, r.ids_crc32, r.length) for r in own) == crcs
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in want)
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for own in inside.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("per_bucket", [20_000, 10])
def test_packing_round_trip(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(packing, "PER_BUCKET", per_bucket)
    docs = [(i, "word " * (i * 37 % 300)) for i in range(120)] + [(500, None), (501, ""), (501, ""), (None, "a b"), (None, None), (7, "other text"), (600, "long words " * 3000)] + [(700 + i, "same text here") for i in range(40)]
    df = spark.createDataFrame(docs, DOCS).withColumn("length", F.lit("clash"))
    got = pack(df, capacity=256).collect()
    check_pieces(got, docs, 256, [2])
    assert sum(r.length for r in got) / (256 * len({r.sequence_id for r in got})) > 0.93
    assert pack(df.where("false")).collect() == []
    none = pack(spark.createDataFrame([(1, None), (2, "x")], DOCS), end_id=None).collect()
    assert [(r.doc_id, r.length) for r in none] == [(2, 1)]


# ---------------------------------------------------------------- pipeline

def test_pipeline_matches_plain_stages(spark, tmp_path):
    from test_text_operators import plain_lines
    rng = np.random.default_rng(11)
    prose = lambda n: " ".join("".join(rng.choice(list("aeioustrn"), 5)) for _ in range(n))
    good = [(i, "\n".join(prose(25) for _ in range(3))) for i in range(150)]
    shared = prose(60)
    good = [(i, t + "\n" + shared if i % 10 == 0 else t) for i, t in good]
    copies = [(200 + i, good[3][1] + (" end" if i % 2 else "")) for i in range(6)]
    junk = [(300 + i, " ".join(f"{w}###" for w in prose(70).split())) for i in range(150)]
    items = [(i, prose(30)) for i in range(5)]
    leaks = [(500 + i, f"{prose(40)} {t} {prose(40)}") for i, t in items]
    docs = [(d, t, "en", "s", len(t)) for d, t in [*good, *copies, *junk, *leaks]]
    at = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, int(d < 300)) for d, *_ in docs if d < 450], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    now, states = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, at)
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            now = spark.createDataFrame(now.collect(), now.schema)
            states.append(sorted((r.doc_id, r.text) for r in now.collect()))
            assert all(r.n_chars == len(r.text) for r in now.collect())
    judged, lines, similar, clean = states
    assert judged == sorted((d, t) for d, t, *_ in docs if not 300 <= d < 450)
    assert lines == sorted((d, t) for d, t, *_ in plain_lines(judged, 10, keep_first=True) if words(t))
    assert {d for d, _ in similar} == {c for _, _, c in plain_components(lines, 5, 80)}
    assert clean == [(d, t) for d, t in similar if d < 500]
    check_pieces(now.collect(), clean, 4096, [2])
    whole = corpus_pipeline.run(spark, at).collect()
    check_pieces(whole, clean, 4096, [2])


def test_lines_are_stripped_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"all\none {i}", "en", "s", 7 + len(str(i))) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    strip = lambda: corpus_pipeline.lines(spark, docs, SF)
    whole = sorted((r.doc_id, r.text) for r in strip().collect())
    assert whole == [(i, "all\none 0" if i == 0 else f"one {i}") for i in range(12)]
    assert strip()._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    monkeypatch.setattr(corpus_pipeline, "line_dedup", lambda *a, **kw: linededup.line_dedup(*a, max_broadcast=0, **kw))
    assert sorted((r.doc_id, r.text) for r in strip().collect()) == whole


def test_the_encoder_goes_with_the_caches():
    from axisflow.llm.common import worker_cache
    first = Encoder.of(VOCAB)
    assert Encoder.of(VOCAB) is first
    worker_cache("lines")
    assert Encoder.of(VOCAB) is not first
