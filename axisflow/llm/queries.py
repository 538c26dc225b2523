"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .frames import fill_in_middle, frame_store
from .htmltext import main_text
from .lexsearch import ranked_search
from .licenses import license_scan
from .linededup import line_dedup
from .ngramjoin import similar_components
from .packing import pack
from .pii import personal_data
from .quality import quality_classifier
from .rules import BASE, quality_rules
from .secrets import secret_scan
from .tokens import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WS = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


@query("op1_line_dedup", f"""
WITH lines AS (
  SELECT rid, any_value(doc_id) AS doc_id, list(line ORDER BY i) AS lines, list(k ORDER BY i) AS keys FROM (
    SELECT rid, doc_id, i, string_split(t, chr(10))[i] AS line,
           translate(regexp_replace(regexp_replace(string_split(t, chr(10))[i], '^{WS}+', ''), '{WS}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT row_number() OVER () AS rid, doc_id, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i
          FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
  GROUP BY rid),
gone AS (SELECT k FROM (SELECT rid, unnest(list_distinct(keys)) AS k FROM lines) WHERE length(k) >= 1 GROUP BY k HAVING count(*) >= 10),
flagged AS (
  SELECT rid, doc_id, lines, keys, (SELECT list(k) FROM gone) AS g FROM lines)
SELECT doc_id, len(lines)::BIGINT AS n_lines,
  len(list_filter(keys, lambda x: list_contains(coalesce(g, []), x)))::BIGINT AS n_dropped,
  sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(lines, keys), lambda x: NOT list_contains(coalesce(g, []), x[2])), lambda x: x[1]), chr(10)), '')) AS kept_sha256
FROM flagged""")
def _op1(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op2_quality_rules")
def _op2(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept")


@query("op3_html_text")
def _op3(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op4_secret_scan")
def _op4(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op5_quality")
def _op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier(docs, table(spark, sf_dir, "labels")).drop("text")


@query("op6_decontamination")
def _op6(spark, sf_dir):
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("n_slots").alias("n_slots"), F.min("changed_slots").alias("changed_slots"))


@query("op7_license_scan")
def _op7(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def _op8(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op9_ngram_join")
def _op9(spark, sf_dir):
    return similar_components(table(spark, sf_dir, "documents"))


@query("op10_packing")
def _op10(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query("op11_personal_data")
def _op11(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op12_fill_in_middle", """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
g AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::UBIGINT AS h1, ('0x' || x[9:16])::UBIGINT AS h2, ('0x' || x[17:24])::UBIGINT AS h3, ('0x' || x[25:32])::UBIGINT AS h4 FROM h),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""")
def _op12(spark, sf_dir):
    made = fill_in_middle(frame_store(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op13_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, list_distinct({TERMS}) AS w FROM benchmark),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
asked AS (SELECT iid, item_id, unnest(w) AS term FROM i),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scored AS (
  SELECT iid, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id,
    sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN d USING (rid), total GROUP BY iid, rid)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10""")
def _op13(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
