"""Line dedup, quality rules, secrets, HTML, licenses and decontamination against plain versions and known answers."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from axisflow.llm import linededup
from axisflow.llm.decontaminate import contaminated, drop_contaminated, words_of
from axisflow.llm.htmltext import Page, host_of, main_text
from axisflow.llm.licenses import REACHES, SHINGLE, TEMPLATES, license_scan, miss_probability
from axisflow.llm.linededup import line_dedup
from axisflow.llm.rules import BASE, quality_rules, statistics, verdict
from axisflow.llm.secrets import KINDS, base_spans, secrets_of, secret_scan

DOCS = "doc_id long, text string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- line dedup

def plain_lines(docs, min_docs, keep_first=False):
    key = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    seen, first = Counter(), {}
    for doc, text in docs:
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            seen[k] += 1
            if doc is not None:
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in docs:
        lines, kept, met = (text or "").split("\n"), [], set()
        for x in lines:
            k = key(x)
            if seen[k] >= min_docs:
                if keep_first and doc is not None and first.get(k) == doc and k not in met:
                    met.add(k)
                else:
                    continue
            kept.append(x)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


LINES = [(1, "Same line \nown a\n\n x"), (2, "\tSAME LINE\nown b"), (3, "same line\nsame line\nÀ"), (4, None), (5, ""), (5, ""), (None, "same line"), (6, "à\nSame  line"), (7, "own a\nown a"), (7, "own a\nown a"),
         (8, "long " * 50_000 + "\nsame line"), (9, "\x1csame line")]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("broadcast", [True, False])
def test_line_dedup_matches_plain_version(spark, keep_first, broadcast):
    docs = spark.createDataFrame(LINES, DOCS).withColumn("N_LINES", F.lit("clash")).withColumn("other", F.lit(1))
    got = line_dedup(docs, min_docs=3, keep_first=keep_first, max_broadcast=linededup.MAX_DROPPED_KEYS if broadcast else 0)
    assert got.columns == ["doc_id", "text", "other", "n_lines", "n_dropped"]
    assert rows(got, "doc_id", "text", "n_lines", "n_dropped") == plain_lines(LINES, 3, keep_first)


def test_line_dedup_min_chars_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "ab\nabcd") for i in range(4)], DOCS)
    assert {r.text for r in line_dedup(docs, min_docs=4, min_chars=3).collect()} == {"ab"}
    assert line_dedup(docs.where("false"), min_docs=2).collect() == []


def test_filters_never_miss_a_repeat(spark):
    docs = spark.createDataFrame([(i, f"line {i % 700}\nonly {i}") for i in range(1400)], DOCS)
    found = linededup.twice_seen(docs.select("text").repartition(5), 1)
    assert found.of([f"line {i}".encode() for i in range(700)]).all()
    assert found.of([f"only {i}".encode() for i in range(1400)]).mean() < 0.1


# ---------------------------------------------------------------- quality rules

def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if many[r] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_plain_version(spark):
    texts = [None, "", " \n\t", "one", "a b c d e f g h " * 3, "x " * 500, "é ü#*$%&|<> \x0b ñ\x0c\r z", "l\nl\n\nl \nm", "a b c d e f g h i a b c d e f g h", "\x85 \xa0", "w" * 100_000, "q w e r t y u i o p " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: tuple(r[c] for c in BASE) for r in statistics(docs).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}


def test_rules_learn_a_threshold_and_keep_the_rest(spark):
    good = [(i, " ".join(f"word{j} x{i}" for j in range(30))) for i in range(200)]
    bad = [(1000 + i, " ".join(f"word{j}### x{i}" for j in range(30))) for i in range(200)]
    docs = spark.createDataFrame([*good, *bad, (9000, None), (None, "a " * 30), (1, good[1][1])], DOCS).withColumn("bad", F.lit("clash")).repartition(3)
    labels = spark.createDataFrame([*[(i, 1) for i, _ in good], *[(i, 0) for i, _ in bad], (None, 0), (9000, None)], "doc_id long, quality int")
    got = quality_rules(docs, labels).collect()
    kept = Counter((r.kept, r.base_failed) for r in got if r.doc_id is not None and r.doc_id < 1000)
    assert kept == {(True, False): 201} and not any(r.kept for r in got if r.doc_id is not None and r.doc_id >= 1000)
    assert len(got) == 403
    without = quality_rules(docs, labels.where("false"))
    assert without.where("kept = base_failed").count() == 0
    assert quality_rules(docs.where("false"), labels).collect() == []


def test_verdict_is_an_ordered_conditional(spark):
    one = spark.createDataFrame([(1.0, 5.0), (9.0, 0.0)], "words double, upper_share double")
    assert [r[0] for r in one.select(verdict([[("words", "<=", 2.0), ("upper_share", ">", 1.0)]])).collect()] == [False, True]
    assert one.select(verdict([])).first()[0] is True


# ---------------------------------------------------------------- secrets

HEXES = "0123456789abcdef" * 2


def test_base_spans():
    text = f"TOKEN = \"abcdefgh1\" secret_token:short api-key=x api_key='AKIA{'B' * 12}' {HEXES}f é {HEXES[:31]} KEY paſſword=12345678"
    spans = [(KINDS[k], text[s:e]) for s, k, e in base_spans(text)]
    assert spans == [("assign", 'TOKEN = "abcdefgh1'), ("assign", f"api_key='AKIA{'B' * 12}"), ("access", "AKIA" + "B" * 12), ("hex", HEXES + "f")]


def test_digest_and_order():
    text = f"password={HEXES}"
    n_assign, n_access, n_hex, linked, sha, spans = secrets_of(text)
    assert (n_assign, n_access, n_hex, linked) == (1, 0, 1, 0)
    assert spans == "assign:0:41,hex:9:41" and sha == hashlib.sha256(spans.encode()).hexdigest()
    assert secrets_of(None) == (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def test_weak_parts_need_a_complement():
    assert secrets_of("pwd: abc1")[3] == 0 and secrets_of("user: anna\nhost=db.example.org")[3] == 0
    assert "weak:" in secrets_of("user: anna\npwd: abc1")[5] and "identifier:0:10" in secrets_of("user: anna\npwd: abc1")[5]
    assert "endpoint:" in secrets_of("see https://db.example.org/x pwd: abc1")[5]
    assert secrets_of("user: anna\n\npwd: abc1")[3] == 0, "another scope"
    apart = "user: anna " + "x" * 320 + " pwd: abc1"
    assert secrets_of(apart)[3] == 2 and secrets_of(apart, reach=300)[3] == 0, "the scope is the bound, a reach only if asked for"


def test_linked_parts_lie_outside_all_base_spans():
    text = "password=" + "ab12" * 8 + "/user=anna pwd=abc1 login=berta"  # the hex span ends inside the assignment
    spans = secrets_of(text)[5].split(",")
    ends = [int(x.split(":")[2]) for x in spans if x.split(":")[0] in ("assign", "access", "hex")]
    assert not [x for x in spans if x.startswith("identifier") and int(x.split(":")[1]) < max(ends)] and any(x.startswith("identifier") for x in spans)


def test_every_partner_within_reach_is_marked():
    bare = "aB3" + "x" * 37
    text = "Access key ID,Secret access key\nAKIA" + "B" * 16 + "," + bare
    s = text.index(bare)
    assert f"weak:{s}:{s + 40}" in secrets_of(text)[5]
    got = secrets_of("user=anna account=shop1 pwd=abc1")[5]
    assert got.count("identifier:") == 2 and got.count("weak:") == 1
    assert secrets_of("see https://a.example.org/x https://b.example.org/y pwd=abc1 z")[5].count("endpoint:") == 2
    assert secrets_of("user=anna pwd=abc1 login=berta pass=abc2")[5].count("identifier:") == 2
    assert secrets_of("user=anna\n\naccount=shop1 pwd=abc1 " + "x" * 300 + " login=berta", reach=300)[5].count("identifier:") == 1


def test_secret_scan_table(spark):
    docs = spark.createDataFrame([(1, "user: anna\npwd: abc1"), (1, "user: anna\npwd: abc1"), (None, None), (2, ""), (3, "a: b " * 30_000 + f"token={HEXES}")], DOCS).withColumn("Spans", F.lit(0))
    got = secret_scan(docs)
    assert got.columns == ["doc_id", "text", "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"]
    assert sorted((r.doc_id or 0, r.n_linked, r.n_hex) for r in got.collect()) == [(0, 0, 0), (1, 2, 0), (1, 2, 0), (2, 0, 0), (3, 0, 1)]
    assert secret_scan(docs.where("false")).collect() == []


# ---------------------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>m<li>n</ul></nav>
<div class="cookie-notice">We use</div><div id=wrap><main><article><header><h1>Title &amp; x</h1><span class=by>By me</span></header><p>One <b>two</b>&nbsp;three
<div class="share-buttons">share</div><ul><li>a<li>b</ul><form><input> sub</form><table><tr><td>c<td>d</table><script>if (a<b) "</p>"</script><section class="comments"><p>nice</p></section></article>
</main><aside>side</aside></div><footer>f</footer><!-- open"""


def test_page_text():
    assert Page(PAGE).text() == "Title & x One two three a b c d"
    assert Page("<article><p><b>a<br>b<p>c</article><div class=ad>x</div>").text() == "a b c"
    assert Page('<div class="content"><p>Hello <i>w</i>orld</p><div class=ad>buy</div></div><div id=sidebar>s</div>').text() == "Hello world"
    assert Page("plain < text & more &lt;b&gt;").text() == "plain < text & more <b>"
    assert Page("").text() == "" and Page("<p>" * 3000 + "deep" + "<div>" * 3000 + "er").text() == "deep er"
    assert host_of("https://u@Ex.org:80/a") == "ex.org" and host_of(None) == "" and host_of("x") == ""


@pytest.mark.parametrize("limit", [1000, 0])
def test_site_templates_go_and_articles_stay(spark, limit):
    soup = "<body><div><span>Home</span> <span>News</span></div><div>Text {0} of page</div><div>Own {0}</div><div><i>All rights {1}</i></div></body>"
    article = "<article><h1>Copy</h1><p>Same words</p><p>Own {0}</p></article>"
    pages = [(i, f"http://a.org/{i}", soup.format(i, "kept by a")) for i in range(30)]
    pages += [(100 + i, f"http://b.org/{i}", soup.format(i, "of b")) for i in range(4)]
    pages += [(200 + i, "http://a.org/copy", "<body><div>Copy one</div><div>Copy two</div></body>") for i in range(40)]
    pages += [(300 + i, "http://a.org/art", article.format(i)) for i in range(20)]
    pages += [(400, None, None), (401, "http://a.org/", ""), (401, "http://a.org/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("TEXT", F.lit("clash"))
    got = main_text(df, max_broadcast=limit)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    by_id = {r.page_id: (r.text, r.n_chars) for r in got.collect()}
    for i in range(30):
        assert by_id[i][0] == f"Text {i} of page Own {i}"
    for i in range(4):
        assert by_id[100 + i][0] == f"Home News Text {i} of page Own {i} All rights of b"
    assert by_id[205] == ("Copy one Copy two", 17) and by_id[303][0] == "Copy Same words Own 3"
    assert by_id[400] == ("", 0) == by_id[401] and got.count() == len(pages)
    assert main_text(df.where("false")).collect() == []


def test_adjacent_templates_and_hosts_of_copies(spark):
    soup = "<body><div>Site name</div><div>Slogan</div><div>{0}</div><div>{1}</div><div>Contact</div><div>Imprint</div><div>Rights</div></body>"
    pages = [(i, f"http://a.org/{i}", soup.format(f"Text {i}", f"Own {i}")) for i in range(30)]
    pages += [(100 + i, f"http://b.org/{i}", soup.format(f"Text {i}", f"Own {i}")) for i in range(20)]
    pages += [(200 + i, f"http://b.org/copy/{i}", soup.format("Copied", f"Copy {i % 2}")) for i in range(100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert all(got[i] == f"Text {i} Own {i}" for i in range(30)) and all(got[100 + i] == f"Text {i} Own {i}" for i in range(20))
    assert all(got[200 + i] == f"Copied Copy {i % 2}" for i in range(100))


# ---------------------------------------------------------------- licenses

def test_license_bands_keep_their_promise():
    assert miss_probability(0.3) < 2e-4 and miss_probability(0.4) < 5e-6
    for low, reach in zip((SHINGLE, *[r + 1 for r in REACHES]), REACHES):  # the least similarity of a whole template
        assert (max(low, reach // 2) - SHINGLE + 1) / (reach + reach // 4 - SHINGLE + 1) >= 0 and low <= reach


def test_licenses_are_found_whole_and_changed(spark):
    body = {k: v for k, v in TEMPLATES.items()}
    docs = [(i, f"Some words before {i}. " * (i % 7) + body[k] + " and words after it." * (i % 3)) for i, k in enumerate(sorted(body))]
    docs += [(500, "x " * 13 + body["gpl-3-or-later"].replace("program", "product")), (501, None), (502, ""), (503, "MIT license"), (None, body["cc0"]), (0, docs[0][1]), (504, "y " * 60_000 + body["mit-short"])]
    df = spark.createDataFrame(docs, DOCS).withColumn("license", F.lit("clash"))
    got = {(r.doc_id, r.license): r for r in license_scan(df).collect()}
    for i, k in enumerate(sorted(body)):
        assert got[i, k].containment == 1.0, k
    assert got[500, "gpl-3-or-later"].containment >= 0.8 and (None, "cc0") in got and got[504, "mit-short"].containment == 1.0
    assert not {501, 502, 503} & {d for d, _ in got}
    assert license_scan(df.where("false")).collect() == [] and license_scan(df, templates={}).collect() == []


def test_notices_beside_each_other_stay(spark):
    mit, gpl2 = TEMPLATES["mit"].replace("hereby", "herewith"), TEMPLATES["gpl-2-or-later"].replace("redistribute", "share")
    disclaimer = TEMPLATES["mit-disclaimer"].replace("AUTHORS", "WRITERS")
    docs = [(1, TEMPLATES["apache-2.0"] + " Or: " + mit), (2, TEMPLATES["mit"] + " " + disclaimer), (3, "x y z " + TEMPLATES["gpl-3-or-later"] + " end of it"),
            (4, TEMPLATES["gpl-3-or-later"] + " " + gpl2), (5, TEMPLATES["gpl-3-or-later"] + " word" * 70 + " " + gpl2)]
    got = {}
    for r in license_scan(spark.createDataFrame(docs, DOCS)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    assert {"apache-2.0", "mit"} <= set(got[1]) and got[1]["apache-2.0"] == 1 and 0.9 < got[1]["mit"] < 1
    assert {"mit", "mit-disclaimer"} <= set(got[2]) and 0.9 < got[2]["mit-disclaimer"] < 1
    assert set(got[3]) == {"gpl-3-or-later"}
    assert {"gpl-2-or-later", "gpl-3-or-later"} <= set(got[5]) and got[5]["gpl-3-or-later"] == 1
    assert {"gpl-2-or-later", "gpl-3-or-later"} <= set(got[4])


# ---------------------------------------------------------------- decontamination

ITEM = "If Anna walks 12 km in 3 hours and Anna rests for 20 minutes how far does Bob go"


def test_slots(spark):
    one = spark.createDataFrame([("Then Anna has 12.5 km, 3 kg § and 50%.",)], "t string")
    assert one.select(words_of(F.col("t"))).first()[0] == ["then", "¤nanna", "has", "§012p5", "§ukm", "§03", "§ukg", "and", "§050", "§u"]


def test_reparameterised_questions(spark):
    items = spark.createDataFrame([(9, ITEM), (9, ITEM), (10, None), (None, "x"), (11, ""), (12, "the quick brown fox jumps over a lazy dog today")], "item_id long, text string")
    docs = [(1, "blah blah If Carla walks 15 km in 4 hours and Carla rests for 25 minutes how far does Dan go today"), (2, "If Carla walks 15 km in 4 hours and Eve rests for 15 minutes how far does Carla go"),
            (3, None), (4, "nothing to see"), (None, ITEM), (5, "x " * 30_000 + ITEM.replace("how far does", "how long does")), (1, "blah blah If Carla walks 15 km in 4 hours and Carla rests for 25 minutes how far does Dan go today"),
            (6, "the quick brown fox jumps over a"), (7, "A\nthe quick\nbrown fox jumps over a lazy dog today")]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(0)).withColumn("covered", F.lit("clash"))
    got = {(r.doc_id, r.item_id): r for r in contaminated(df, items).collect()}
    assert set(got) == {(1, 9), (None, 9), (7, 12)}, "changed values pass, inconsistent ones, half a window or a changed middle do not"
    assert got[1, 9].changed_slots > 0 and got[None, 9].changed_slots == 0 and got[None, 9].covered == 1.0
    kept = drop_contaminated(df, items)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6]
    assert contaminated(df.where("false"), items).collect() == [] and contaminated(df, items.where("false")).collect() == []


def test_every_verbatim_item_is_found(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: f" {' '.join(t.split())} "
    known = [(r.item_id, flat(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in known if t in flat(r.text)}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    assert want <= got and len(got) <= len(want) + 3


SEQUENCE = "Which number comes next in the sequence 2, 4, 6, 8, 10, 12, 14?"
FRUIT = "Anna has 3 apples and 2 pears, Ben has 5 apples and 7 pears, who has more fruit in the end?"


def test_repeated_template_windows_are_aligned(spark):
    items = spark.createDataFrame([(1, SEQUENCE), (2, FRUIT)], "item_id long, text string")
    docs = [(1, "He asked. " + SEQUENCE), (2, "List 90, 80, 70, 60, 50, 40, 30 first. " + SEQUENCE), (3, FRUIT + " Say."), (4, FRUIT.replace("pears, Ben", "pears, but then Ben")),
            (5, SEQUENCE.replace("4, 6, 8, 10, 12, 14", "2, 2, 2, 2, 2, 2")), (6, FRUIT.replace("3 apples", "4 apples").replace("7 pears", "9 pears"))]
    got = {(r.doc_id, r.item_id): r for r in contaminated(spark.createDataFrame(docs, DOCS), items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (6, 2)}
    assert [got[k].changed_slots for k in ((1, 1), (2, 1), (3, 2), (4, 2), (6, 2))] == [0, 0, 0, 0, 2] and got[2, 1].covered == 1 and got[1, 1].n_slots == 7
