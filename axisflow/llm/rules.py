"""Quality rules: text statistics, and an ordered list of threshold rules learned from labelled statistics.

Statistics, learning counts and verdicts are DataFrame and SQL functions; only bin counts reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACES, columns_of, put, run_hashes, small

BINS = 64          # quantiles per feature; thresholds lie halfway between those that differ
MAX_RULES = 12
MAX_CONDITIONS = 4
PRECISION = 0.85   # of a rule on the rows it is pruned on
SUPPORT = 5        # labelled rows a rule must cover there

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

# What rules may test, from the statistics; a word counts as at least one.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}

UPPER, DIGITS, MARKS, SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?.,;:", "#*$%&|<>"
WHITE = "\t\n\x0b\x0c\r "


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of BASE, n_lines (with a word), n_distinct_words, n_upper, n_marks and n_digits.

    Words are runs without ASCII white space. n_repeat_words counts the words that lie in a run of eight which the text
    has twice or more. A null text has no words. Columns of these names in ``docs`` give way.
    """
    text = F.coalesce(F.col(f"`{next(c for c in docs.columns if c.lower() == text_col.lower())}`"), F.lit(""))
    df = put(docs, _stat_text=text)
    df = put(df, _stat_words=F.filter(F.split("_stat_text", f"[{SPACES}]+", -1), lambda w: w != ""), _stat_lines=F.filter(F.split("_stat_text", "\n", -1), lambda x: x.rlike(f"[^{SPACES}]")))
    df = put(df, _stat_n=F.size("_stat_words"), _stat_runs=run_hashes(F.col("_stat_words"), 8))
    # only texts that repeat a run go further: their runs in order of hash, neighbours that are equal, their places in order
    df = put(df, _stat_sorted=F.expr("CASE WHEN size(_stat_runs) > size(array_distinct(_stat_runs)) THEN array_sort(transform(_stat_runs, (h, i) -> struct(h AS h, i AS i))) END"))
    df = put(df, _stat_places=F.expr("CASE WHEN _stat_sorted IS NOT NULL THEN array_sort(array_distinct(flatten(zip_with(slice(_stat_sorted, 1, size(_stat_sorted) - 1), slice(_stat_sorted, 2, size(_stat_sorted) - 1), "
                                "(a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) ELSE cast(array() AS array<int>) END)))) END"))
    df = put(df, _stat_repeat=F.expr("CASE WHEN _stat_places IS NOT NULL THEN 8 + aggregate(zip_with(slice(_stat_places, 1, size(_stat_places) - 1), slice(_stat_places, 2, size(_stat_places) - 1), "
                                "(a, b) -> least(8, b - a)), 0, (s, x) -> s + x) ELSE 0 END"))
    own = F.col("_stat_text")
    return put(df, n_words=F.col("_stat_n").cast("long"), word_chars=F.length(F.translate(own, WHITE, "")).cast("long"), n_symbols=_count(own, SYMBOLS),
               n_dup_lines=(F.size("_stat_lines") - F.size(F.array_distinct("_stat_lines"))).cast("long"), n_repeat_words=F.col("_stat_repeat").cast("long"), n_lines=F.size("_stat_lines").cast("long"),
               n_distinct_words=F.size(F.array_distinct("_stat_words")).cast("long"), n_upper=_count(own, UPPER), n_marks=_count(own, MARKS), n_digits=_count(own, DIGITS)
               ).drop("_stat_text", "_stat_words", "_stat_lines", "_stat_n", "_stat_runs", "_stat_sorted", "_stat_places", "_stat_repeat")


Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold
Rule = list[Condition]


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    shares = [i / BINS for i in range(1, BINS)]
    got = rows.agg(*[F.array_append(F.array_append(F.percentile_approx(f, shares, 2000), F.min(f)), F.max(f)).alias(f) for f in FEATURES]).first()
    values = {f: sorted(set(got[f] or [])) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}


def _rule_sql(rule: Rule) -> str:
    return " AND ".join(f"{f} {op} {t!r}D" for f, op, t in rule) or "true"


def _bin_counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """Per feature and bin: bad and good rows. A bin number is how many thresholds lie below the value."""
    bins = ", ".join("'{0}', cast({1} AS int)".format(f, " + ".join(f"int({f} > {t!r}D)" for t in ts) or "0") for f, ts in cuts.items())
    long = rows.selectExpr("bad", f"stack({len(cuts)}, {bins}) AS (feature, bin)")
    out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in cuts}
    for r in long.groupBy("feature", "bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect():
        out[r.feature][r.bin] = (r.bad, r.n - r.bad)
    return out


def _best(counts: dict, cuts: dict[str, list[float]], rule: Rule) -> Condition | None:
    """The condition with the greatest gain of information about bad rows; ties go to the first feature and threshold."""
    best, choice = 1e-9, None
    for f, ts in cuts.items():
        bad, good = sum(c[0] for c in counts[f].values()), sum(c[1] for c in counts[f].values())
        if not bad or not good:
            continue
        before, low_bad, low_good = math.log2(bad / (bad + good)), 0, 0
        for i, t in enumerate(ts):
            b, g = counts[f].get(i, (0, 0))
            low_bad, low_good = low_bad + b, low_good + g
            for op, p, n in (("<=", low_bad, low_good), (">", bad - low_bad, good - low_good)):
                if p >= SUPPORT and n < good and (f, op, t) not in rule:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > best:
                        best, choice = gain, (f, op, t)
    return choice


def learn_rules(labelled: DataFrame, max_rules: int = MAX_RULES) -> list[Rule]:
    """Sequential covering: rules that find bad rows, each grown on two thirds of what is left and pruned on the rest.

    ``labelled`` has the features, ``bad`` (0/1) and ``pick`` (a hash that splits the rows). A rule grows by the condition
    of greatest gain until it covers no good row or has MAX_CONDITIONS; of its beginnings the one with the best
    (bad - good) / covered on the pruning rows stays. Covered rows leave; it ends at a rule below PRECISION or SUPPORT.
    """
    rows = cut_lineage(labelled.select("bad", "pick", *FEATURES))
    cuts = {f: ts for f, ts in _thresholds(rows).items() if ts}
    rules: list[Rule] = []
    if not cuts:
        return rules
    left = "true"
    while len(rules) < max_rules:
        rule: Rule = []
        grow = rows.where(left).where("pick % 3 < 2")
        while len(rule) < MAX_CONDITIONS:
            choice = _best(_bin_counts(grow.where(_rule_sql(rule)), cuts), cuts, rule)
            if choice is None:
                break
            rule.append(choice)
        if not rule:
            break
        prune = rows.where(left).where("pick % 3 = 2")
        tests = [e for k in range(1, len(rule) + 1) for e in (F.expr(f"sum(CASE WHEN {_rule_sql(rule[:k])} THEN bad ELSE 0 END)"), F.expr(f"count_if({_rule_sql(rule[:k])})"))]
        got = prune.agg(*[t.alias(f"c{i}") for i, t in enumerate(tests)]).first()
        scored = [((2 * (got[2 * k] or 0) - got[2 * k + 1]) / got[2 * k + 1], k + 1) for k in range(len(rule)) if got[2 * k + 1] >= SUPPORT]
        if not scored:
            break
        value, keep = max(scored, key=lambda s: (s[0], -s[1]))
        if (value + 1) / 2 < PRECISION:
            break
        rules.append(rule[:keep])
        left = " AND ".join(f"NOT ({_rule_sql(r)})" for r in rules)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditions: the first rule that holds rejects, a text that none holds for is kept."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(F.expr(_rule_sql(rule)), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, the statistics of BASE, base_failed, kept) of every row, and the features the learned rules test.

    Rules are learned from all rows with a label 0 or 1 that pass the base checks. Null and empty texts have no words
    and fail the base. A null id has no label; repeated labels and rows count as often as they occur. Without labels of
    both classes nothing but the base rejects. Other input columns are not returned. An empty table gives an empty table.
    """
    counted = statistics(columns_of(docs, id_col, text_col), text_col).drop(text_col)
    counted = cut_lineage(counted.withColumn("base_failed", F.expr(BASE_FAILED)).withColumns({f: F.expr(f"cast({e} AS double)") for f, e in FEATURES.items()}))
    marked = columns_of(labels, id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_lid"), (1 - F.col(label_col)).cast("int").alias("bad"))
    known = counted.where("NOT base_failed").join(small(marked), F.col(id_col) == F.col("_lid")).withColumn("pick", F.pmod(F.xxhash64(id_col), F.lit(1 << 20)))
    rules = learn_rules(known)
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules))
