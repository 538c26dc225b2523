"""Agreement between runs, methods, rankings and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as a
from ..operators import windows as w
from .base import R, Tables, query, rounded, with_

_PA = {"ca": "SELECT cluster AS k, [avg(x[1]), avg(x[2]), avg(x[3]), avg(x[4]), avg(x[5])] AS p FROM emb GROUP BY 1", "cb": "SELECT cluster AS k, [avg(x[2]), avg(x[1]), avg(x[3]), avg(x[4]), avg(x[6])] AS p FROM emb GROUP BY 1",
       "cs": "SELECT ca.k AS ka, cb.k AS kb, list_dot_product(ca.p, cb.p) / ((sqrt(list_dot_product(ca.p, ca.p)) + 1e-8) * (sqrt(list_dot_product(cb.p, cb.p)) + 1e-8)) AS c FROM ca, cb"}


def _patterns(t: Tables, order):
    return t.emb.groupBy(F.col("cluster").alias("k")).agg(F.array(*[F.avg(F.col("x")[i]) for i in order]).alias("p"))


@query("pattern_cosine", with_("emb", extra=_PA, body=f"SELECT ka, kb, {R('c')} AS cosine FROM cs"))
def _(t: Tables):
    return rounded(a.pattern_cosine(_patterns(t, [0, 1, 2, 3, 4]), _patterns(t, [1, 0, 2, 3, 5])))


@query("greedy_match")
def _(t: Tables):
    m = a.greedy_match(a.pattern_cosine(_patterns(t, [0, 1, 2, 3, 4]), _patterns(t, [1, 0, 2, 3, 5])))
    return rounded(a.match_summary(m))


# the same set matched with itself keeps every index
@query("greedy_match_self", "SELECT label AS ka, label AS kb, 1e0 AS cosine FROM embeddings GROUP BY 1")
def _(t: Tables):
    p = _patterns(t, range(64))
    return rounded(a.greedy_match(a.pattern_cosine(p, p)))


_TYPES = ["click", "error", "purchase", "signup", "view"]


def _perm_sql(k: int) -> str:
    from itertools import permutations
    return ", ".join("[" + ", ".join(str(x) for x in p) + "]" for p in permutations(range(k)))


@query("best_match", with_("ax", extra={"cv": "SELECT CASE WHEN user_id < 75 THEN 0 ELSE 1 END AS run, event_type AS k, least(floor(t * 20e0), 19)::INT AS t_idx, avg(value) AS v FROM ax GROUP BY 1, 2, 3",
    "cr": "SELECT dense_rank() OVER (ORDER BY k1) - 1 AS ka, dense_rank() OVER (ORDER BY k2) - 1 AS kb, abs(r) AS c FROM (SELECT x.k AS k1, y.k AS k2, corr(x.v, y.v) AS r FROM cv x JOIN cv y ON x.t_idx = y.t_idx AND x.run = 0 AND y.run = 1 GROUP BY 1, 2)",
    "pm": f"SELECT unnest([{_perm_sql(5)}]) AS p"}, body=f"SELECT {R('max(m)')} AS mean_matched FROM (SELECT p, avg(c) AS m FROM pm, (SELECT unnest(range(5)) AS i) JOIN cr ON ka = i WHERE kb = p[i + 1] GROUP BY 1)"))
def _(t: Tables):
    half = F.when(F.col("user_id") < 75, 0).otherwise(1)
    cv = t.ax.withColumn("run", half).withColumn("t_idx", w.bin_index("t", 20)).groupBy("run", F.col("event_type").alias("k"), "t_idx").agg(F.avg("value").alias("v"))
    x = cv.where(F.col("run") == 0).select("t_idx", F.col("k").alias("k1"), F.col("v").alias("v1"))
    y = cv.where(F.col("run") == 1).select("t_idx", F.col("k").alias("k2"), F.col("v").alias("v2"))
    pos = F.array(*[F.lit(x) for x in _TYPES])
    c = x.join(y, "t_idx").groupBy("k1", "k2").agg(F.abs(F.corr("v1", "v2")).alias("c"))
    c = c.select((F.array_position(pos, F.col("k1")) - 1).alias("ka"), (F.array_position(pos, F.col("k2")) - 1).alias("kb"), "c")
    return rounded(a.best_match(c, 5))


_RUNPK = {"pk": "SELECT user_id, arg_max(t, m) AS peak FROM (SELECT user_id, (least(floor(t * 40e0), 39) + 0.5e0) / 40e0 AS t, avg(value) AS m FROM ax GROUP BY 1, 2) GROUP BY 1"}


@query("peak_overlap", with_("ax", extra=_RUNPK, body=f"""SELECT count(*) AS n_runs, {R('stddev_pop(peak)')} AS peak_std, {R('(SELECT avg(CASE WHEN abs(x.peak - y.peak) <= 0.111 THEN 1e0 ELSE 0e0 END) FROM pk x JOIN pk y ON x.user_id < y.user_id)')} AS overlap_frac FROM pk"""))
def _(t: Tables):
    m = t.ax.withColumn("t_idx", w.bin_index("t", 40)).groupBy("user_id", "t_idx").agg(F.avg("value").alias("v")).withColumn("t", (F.col("t_idx") + 0.5) / 40.0)
    pk = m.groupBy(F.col("user_id").alias("run")).agg(F.max_by("t", F.struct("v", -F.col("t_idx"))).alias("peak"))
    return rounded(a.peak_overlap(pk, 0.111))


@query("sensitivity_report")
def _(t: Tables):
    cfg = t.emb.withColumn("config", F.when(F.col("cell_id") % 2 == 0, "even").otherwise("odd"))
    pat = cfg.groupBy("config", F.col("cluster").alias("k")).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(64)]).alias("p"))
    names = F.when(F.col("event_type").isin("click", "view"), "even").otherwise("odd")
    cv = t.ax.withColumn("t_idx", w.bin_index("t", 40)).groupBy(names.alias("config"), "t_idx").agg(F.avg("value").alias("v")).withColumn("t", (F.col("t_idx") + 0.5) / 40.0)
    auroc = t.events.groupBy(names.alias("config")).agg((F.avg("value") / 100).alias("auroc"))
    return rounded(a.sensitivity_report(pat, cv, auroc, "even"))


_RKS = {"s": "SELECT l_returnflag AS method, l_partkey AS feature, round(avg(l_discount) * 1000 + avg(l_tax), 9) AS score FROM lineitem GROUP BY 1, 2", "rk": "SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS rank FROM s",
        "ov": """SELECT k, x.method AS m1, y.method AS m2, count(*) FILTER (x.feature = y.feature) AS b FROM (SELECT unnest([50, 100, 200]) AS k) JOIN rk x ON x.rank <= k JOIN rk y ON y.rank <= k AND x.method < y.method GROUP BY 1, 2, 3"""}


def _rankings(t: Tables):
    from ..functions.ranking import top_n
    s = t.lineitem.groupBy(F.col("l_returnflag").alias("method"), F.col("l_partkey").alias("feature")).agg(F.round(F.avg("l_discount") * 1000 + F.avg("l_tax"), 9).alias("score"))
    return s, top_n(s, 200, [F.col("score").desc(), F.col("feature")], ["method"])


@query("ranking_overlap", with_(extra=_RKS, body=f"SELECT k, m1, m2, {R('b / (2 * k - b)::DOUBLE')} AS jaccard FROM ov"))
def _(t: Tables):
    return rounded(a.ranking_overlap(_rankings(t)[1], [50, 100, 200]))


@query("mean_overlap", with_(extra=_RKS, body=f"SELECT k, {R('avg(b / (2 * k - b)::DOUBLE)')} AS mean_jaccard FROM ov GROUP BY 1"))
def _(t: Tables):
    return rounded(a.mean_overlap(a.ranking_overlap(_rankings(t)[1], [50, 100, 200])))


def _spear(src: str, item: str) -> dict[str, str]:
    return {"pr": f"SELECT x.method AS m1, y.method AS m2, x.score AS v1, y.score AS v2 FROM {src} x JOIN {src} y ON x.{item} = y.{item} AND x.method < y.method",
            "rr": "SELECT m1, m2, rank() OVER (PARTITION BY m1, m2 ORDER BY v1) + (count(*) OVER (PARTITION BY m1, m2, v1) - 1) / 2e0 AS r1, rank() OVER (PARTITION BY m1, m2 ORDER BY v2) + (count(*) OVER (PARTITION BY m1, m2, v2) - 1) / 2e0 AS r2 FROM pr"}


@query("spearman_of_scores", with_(extra={**_RKS, **_spear("s", "feature")}, body=f"SELECT m1, m2, count(*) AS n, {R('corr(r1, r2)')} AS rho FROM rr GROUP BY 1, 2"))
def _(t: Tables):
    return rounded(a.spearman_pairs(_rankings(t)[0], "feature"))


@query("set_compare", """SELECT coalesce(a.f, b.f) AS feature, CASE WHEN a.f IS NULL THEN 'b_only' WHEN b.f IS NULL THEN 'a_only' ELSE 'shared' END AS "where" FROM (SELECT DISTINCT l_partkey AS f FROM lineitem WHERE l_quantity > 48) a
    FULL JOIN (SELECT DISTINCT l_partkey AS f FROM lineitem WHERE l_discount >= 0.1) b ON a.f = b.f""")
def _(t: Tables):
    x = t.lineitem.where(F.col("l_quantity") > 48).select(F.col("l_partkey").alias("feature"))
    return a.set_compare(x, t.lineitem.where(F.col("l_discount") >= 0.1).select(F.col("l_partkey").alias("feature")))


@query("branch_sets", """WITH m AS (SELECT DISTINCT l_returnflag AS branch, l_partkey AS f FROM lineitem WHERE l_quantity > 45)
    SELECT f AS feature, count(*) AS n_branches, CASE WHEN count(*) = 1 THEN min(branch) END AS branch, CASE WHEN count(*) = 1 THEN 'exclusive' WHEN count(*) = (SELECT count(DISTINCT branch) FROM m) THEN 'shared_by_all' ELSE 'some' END AS kind FROM m GROUP BY 1""")
def _(t: Tables):
    m = t.lineitem.where(F.col("l_quantity") > 45).select(F.col("l_returnflag").alias("branch"), F.col("l_partkey").alias("feature"))
    return a.branch_sets(m)


# three orderings of the suppliers' parts within each brand
_ORD = {"o": """SELECT p_brand AS branch, p_partkey AS cell_id, 'price' AS method, p_retailprice AS score FROM part UNION ALL SELECT p_brand, p_partkey, 'size', p_size FROM part UNION ALL
        SELECT p_brand, p_partkey, 'flow', sum(l_quantity) FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2""",
        "pr": "SELECT x.branch, x.method AS m1, y.method AS m2, x.score AS v1, y.score AS v2 FROM o x JOIN o y ON x.branch = y.branch AND x.cell_id = y.cell_id AND x.method < y.method",
        "rr": "SELECT branch, m1, m2, rank() OVER (PARTITION BY branch, m1, m2 ORDER BY v1) + (count(*) OVER (PARTITION BY branch, m1, m2, v1) - 1) / 2e0 AS r1, rank() OVER (PARTITION BY branch, m1, m2 ORDER BY v2) + (count(*) OVER (PARTITION BY branch, m1, m2, v2) - 1) / 2e0 AS r2 FROM pr",
        "rh": "SELECT branch, m1, m2, count(*) AS n, corr(r1, r2) AS rho FROM rr GROUP BY 1, 2, 3"}


@query("ordering_agreement", with_(extra=_ORD, body=f"SELECT branch, n_rows, {R('avg(rho)')} AS mean_rho, {R('min(rho)')} AS min_rho, min(rho) >= 0.05 AS above_threshold FROM rh JOIN (SELECT p_brand AS branch, count(*) AS n_rows FROM part GROUP BY 1) USING (branch) WHERE n >= 10 AND n_rows >= 20 GROUP BY 1, 2"))
def _(t: Tables):
    p = t.part
    flow = p.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_partkey").agg(F.sum("l_quantity").alias("score"))
    long = (p.select(F.col("p_brand").alias("branch"), F.col("p_partkey").alias("cell_id"), F.lit("price").alias("method"), F.col("p_retailprice").alias("score"))
            .union(p.select("p_brand", "p_partkey", F.lit("size"), F.col("p_size").cast("double")))
            .union(flow.select("p_brand", "p_partkey", F.lit("flow"), "score")))
    return rounded(a.ordering_agreement(long, 0.05))


_C1 = {"sa": "SELECT p_brand AS cluster, avg(l_quantity) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1", "sb": "SELECT p_brand AS cluster, avg(l_discount) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"}


@query("concordance_scores", with_(extra=_C1, body=f"""SELECT count(*) AS n_clusters, {R('corr(r1, r2)')} AS rho, arg_max(cluster, v1) AS top_a, arg_max(cluster, v2) AS top_b, arg_max(cluster, v1) = arg_max(cluster, v2) AS argmax_match FROM
    (SELECT cluster, sa.s AS v1, sb.s AS v2, rank() OVER (ORDER BY sa.s) AS r1, rank() OVER (ORDER BY sb.s) AS r2 FROM sa JOIN sb USING (cluster))"""))
def _(t: Tables):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("cluster")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    return rounded(a.concordance_scores(j.select("cluster", F.col("q").alias("score")), j.select("cluster", F.col("d").alias("score"))))


_C2 = {"v": "SELECT p_brand AS cluster, l_suppkey AS feature, avg(l_discount) - 0.05e0 AS w1, avg(l_tax) - 0.04e0 AS w2, avg(l_discount) * 100 + avg(l_tax) AS s1, avg(l_tax) * 100 + avg(l_discount) AS s2 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"}


def _two_vectors(t: Tables):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("cluster"), F.col("l_suppkey").alias("feature")).agg(
        (F.avg("l_discount") - 0.05).alias("w1"), (F.avg("l_tax") - 0.04).alias("w2"), F.round(F.avg("l_discount") * 100 + F.avg("l_tax"), 9).alias("s1"), F.round(F.avg("l_tax") * 100 + F.avg("l_discount"), 9).alias("s2"))


@query("concordance_vectors", with_(extra=_C2, body=f"SELECT cluster, {R('abs(sum(w1 * w2) / ((sqrt(sum(w1 * w1)) + 1e-12) * (sqrt(sum(w2 * w2)) + 1e-12)))')} AS abs_cosine FROM v GROUP BY 1"))
def _(t: Tables):
    v = _two_vectors(t)
    return rounded(a.concordance_vectors(v.select("cluster", "feature", F.col("w1").alias("w")), v.select("cluster", "feature", F.col("w2").alias("w"))))


@query("concordance_vector_null")
def _(t: Tables):
    v = _two_vectors(t)
    n = v.select("feature").distinct().count()
    c = a.concordance_vectors(v.select("cluster", "feature", F.col("w1").alias("w")), v.select("cluster", "feature", F.col("w2").alias("w")))
    q = a.random_cosine_null(t.spark, n, 300).scalar()
    return rounded(c.agg(F.avg("abs_cosine").alias("mean_abs_cosine"), q.alias("null_q"), F.avg(F.when(F.col("abs_cosine") > q, 1.0).otherwise(0.0)).alias("above")))


_C3 = {**_C2, "r": "SELECT cluster, feature, round(s1, 9) AS s1, round(s2, 9) AS s2 FROM v",
       "q": """SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s1 DESC, feature) AS p1, row_number() OVER (PARTITION BY cluster ORDER BY s2 DESC, feature) AS p2, rank() OVER (PARTITION BY cluster ORDER BY s1) + (count(*) OVER (PARTITION BY cluster, s1) - 1) / 2e0 AS r1,
       rank() OVER (PARTITION BY cluster ORDER BY s2) + (count(*) OVER (PARTITION BY cluster, s2) - 1) / 2e0 AS r2 FROM r""", "b": "SELECT cluster, count(*) FILTER (p1 <= 30 AND p2 <= 30) AS b, corr(r1, r2) AS rho FROM q GROUP BY 1"}


@query("concordance_lists", with_(extra=_C3, body=f"SELECT cluster, {R('b / (60 - b)::DOUBLE')} AS jaccard, {R('rho')} AS rho, {R('30 / 170e0')} AS chance, {R('b / (60 - b)::DOUBLE / (30 / 170e0)')} AS fold FROM b"))
def _(t: Tables):
    v = _two_vectors(t)
    return rounded(a.concordance_lists(v.select("cluster", "feature", F.col("s1").alias("score")), v.select("cluster", "feature", F.col("s2").alias("score")), 30, 100))


_WP = {"g": "SELECT i::INT AS t_idx, 0.1e0 + 0.8e0 * i / 9 AS c FROM (SELECT unnest(range(10)) AS i)", "e": """SELECT t_idx, cell_id, list_sum([x[i] * sin((t_idx + 1) * i * 1e0) for i in range(1, 9)]) AS sa, list_sum([x[i] * cos((t_idx + 1) * i * 1e0) for i in range(1, 9)]) AS sb
       FROM fold, g WHERE abs(t - c) <= 0.08""", "q": "SELECT t_idx, rank() OVER (PARTITION BY t_idx ORDER BY sa) AS r1, rank() OVER (PARTITION BY t_idx ORDER BY sb) AS r2 FROM e"}


@query("window_projection_agreement", with_("fold", extra=_WP, body=f"SELECT t_idx, count(*) AS n, {R('abs(corr(r1, r2))')} AS abs_rho FROM q GROUP BY 1 HAVING count(*) >= 10"))
def _(t: Tables):
    grid = w.linspace(0.1, 0.9, 10)
    rows = t.spark.range(10).select(F.col("id").cast("int").alias("t_idx"), F.element_at(F.array(*[F.lit(x) for x in grid]), (F.col("id") + 1).cast("int")).alias("t"))
    d = rows.select("t_idx", "t", *[F.array(*[fn((F.col("t_idx") + 1) * float(i)) for i in range(1, 9)]).alias(n) for fn, n in ((F.sin, "va"), (F.cos, "vb"))])
    return rounded(a.window_projection_agreement(t.fold.select("cell_id", "t", F.col("x").alias("xa"), F.col("x").alias("xb")), d, 0.08))


_G = w.linspace(0.05, 0.95, 30)
_CR = {"q": "SELECT unnest(range(30))::INT AS i, unnest([" + ", ".join(f"{x!r}::DOUBLE" for x in _G) + "]) AS g",
       "sg": "SELECT k, t AS t0, a - 0.5e0 AS a0, lead(t) OVER p AS t1, lead(a) OVER p - 0.5e0 AS a1 FROM act WINDOW p AS (PARTITION BY k ORDER BY t)",
       "sl": "SELECT t AS t0, lam AS a0, lead(t) OVER p AS t1, lead(lam) OVER p AS a1 FROM lam WINDOW p AS (ORDER BY t)",
       "ra": "SELECT k, i, g, a0 + (a1 - a0) * (g - t0) / (t1 - t0) AS r FROM q JOIN sg ON g >= t0 AND g < t1", "rl": "SELECT i, a0 + (a1 - a0) * (g - t0) / (t1 - t0) AS s FROM q JOIN sl ON g >= t0 AND g < t1"}


@query("curve_recovery", with_("act", "lam", extra=_CR, body=f"""SELECT k, {R('corr(r, s)')} AS pearson, {R('avg(CASE WHEN sign(r) = sign(s) THEN 1e0 ELSE 0e0 END)')} AS sign_agreement, {R('sqrt(avg((r - s) ** 2))')} AS rmse, {R('abs(arg_max(g, r) - arg_max(g, s))')} AS peak_error,
    false AS spurious_peak FROM ra JOIN rl USING (i) GROUP BY 1"""))
def _(t: Tables):
    truth = t.act.select("k").distinct()
    lam = t.lam.agg(F.collect_list(F.struct("t", F.col("lam").alias("v"))).alias("c")).scalar()
    truth = truth.withColumn("_c", F.explode(lam)).select("k", "_c.t", "_c.v")
    return rounded(a.curve_recovery(t.act.select("k", "t", (F.col("a") - 0.5).alias("v")), truth, _G, ["k"]))


_BM = {"s": "SELECT l_returnflag AS branch, 'p' || l_partkey::VARCHAR AS feature, round(avg(l_discount) * 1000 + avg(l_tax), 9) AS score FROM lineitem GROUP BY 1, 2", "rk": "SELECT *, row_number() OVER (PARTITION BY branch ORDER BY score DESC, feature) AS rank FROM s",
       "mk": "SELECT DISTINCT l_returnflag AS branch, 'P' || l_partkey::VARCHAR AS feature FROM lineitem WHERE l_discount >= 0.1 AND l_quantity > 47 AND l_tax > 0.06",
       "me": "SELECT avg(v) AS v FROM (SELECT b.branch, coalesce(count(*) FILTER (t.feature IS NOT NULL) / count(mk.feature)::DOUBLE, 0) AS v FROM (SELECT DISTINCT branch FROM s) b JOIN mk USING (branch) LEFT JOIN (SELECT branch, upper(feature) AS feature FROM rk WHERE rank <= 60) t ON t.branch = mk.branch AND t.feature = mk.feature GROUP BY 1)",
       "jc": "SELECT 1 - avg(b / (400 - b)::DOUBLE) AS v FROM (SELECT x.branch, y.branch, count(*) FILTER (x.feature = y.feature) AS b FROM rk x JOIN rk y ON x.branch < y.branch AND x.rank <= 200 AND y.rank <= 200 GROUP BY 1, 2)",
       "pk": "SELECT l_returnflag AS branch, l_linenumber AS seed, avg(l_discount) * 10 AS peak FROM lineitem GROUP BY 1, 2", "sd": "SELECT 1 / (1 + avg(s)) AS v FROM (SELECT branch, stddev_pop(peak) AS s FROM pk GROUP BY 1)",
       "tm": "SELECT least(stddev_pop(p) / 0.5, 1e0) AS v FROM (SELECT branch, arg_min(peak, seed) AS p FROM pk GROUP BY 1)", "r2": "SELECT avg(r) AS v FROM (SELECT l_returnflag, avg(l_tax) * 10 AS r FROM lineitem GROUP BY 1)"}


@query("benchmark_score", with_(extra=_BM, body=f"""SELECT {R('me.v')} AS marker, {R('jc.v')} AS specificity, {R('sd.v')} AS stability, {R('tm.v')} AS timing, {R('r2.v')} AS r2, {R('0.3 * me.v + 0.2 * jc.v + 0.2 * sd.v + 0.15 * tm.v + 0.15 * r2.v')} AS composite FROM me, jc, sd, tm, r2"""))
def _(t: Tables):
    from ..functions.ranking import top_n
    li = t.lineitem
    s = li.groupBy(F.col("l_returnflag").alias("branch"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("feature")).agg(F.round(F.avg("l_discount") * 1000 + F.avg("l_tax"), 9).alias("score"))
    ranked = top_n(s, 200, [F.col("score").desc(), F.col("feature")], ["branch"])
    markers = li.where((F.col("l_discount") >= 0.1) & (F.col("l_quantity") > 47) & (F.col("l_tax") > 0.06)).select(F.col("l_returnflag").alias("branch"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("feature"))
    peaks = li.groupBy(F.col("l_returnflag").alias("branch"), F.col("l_linenumber").alias("seed")).agg((F.avg("l_discount") * 10).alias("peak"))
    fits = li.groupBy(F.col("l_returnflag").alias("branch")).agg((F.avg("l_tax") * 10).alias("r2"))
    return rounded(a.benchmark_score(ranked, markers, peaks, fits, 60, 200))


@query("safe_pivot", "SELECT event_type, " + ", ".join(R(f"avg(value) FILTER (user_id = {u})") + f" AS u{u}" for u in (3, 1, 99999)) + " FROM events GROUP BY 1")
def _(t: Tables):
    out = a.safe_pivot(t.events, "event_type", "user_id", [3, 1, 99999], "value")
    return rounded(out.withColumnsRenamed({"3": "u3", "1": "u1", "99999": "u99999"}))


@query("evaluate_thresholds", """WITH m AS (SELECT c_nationkey AS system, any_value(CASE WHEN c_nationkey % 2 = 0 THEN 'sequential' ELSE 'none' END) AS signal, avg(c_acctbal) / 5000 AS value, min(c_acctbal) + 1000 AS pmin, quantile_cont(c_acctbal, 0.9) / 100000 AS pmax FROM customer GROUP BY 1)
    SELECT system, signal, CASE WHEN signal = 'sequential' THEN value >= 0.9 AND pmax < 0.085 ELSE NOT (pmin / 1000 < 0.085) END AS passed FROM m""")
def _(t: Tables):
    g = t.customer.groupBy(F.col("c_nationkey").alias("system")).agg((F.avg("c_acctbal") / 5000).alias("value"), ((F.min("c_acctbal") + 1000) / 1000).alias("pmin"), (F.percentile("c_acctbal", 0.9) / 100000).alias("pmax"))
    metrics = g.select("system", F.when(F.col("system") % 2 == 0, "sequential").otherwise("none").alias("signal"), F.lit("tau").alias("metric"), "value")
    even = F.col("system") % 2 == 0
    p = g.select("system", F.lit("tau").alias("metric"), F.when(even, F.col("pmax")).otherwise(F.col("pmin")).alias("p"))
    return a.evaluate_thresholds(metrics, p, {"sequential": {"need": {"tau": 0.9}}, "none": {"forbid": ["tau"]}}, 0.085)


@query("best_run", f"SELECT method, first(run ORDER BY m DESC, run) AS run, {R('max(m)')} AS mean_r2 FROM (SELECT l_returnflag AS method, l_linenumber AS run, avg(r) AS m FROM (SELECT l_returnflag, l_linenumber, l_linestatus, avg(l_discount) * 10 AS r FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables):
    r = t.lineitem.groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("run"), F.col("l_linestatus").alias("branch")).agg((F.avg("l_discount") * 10).alias("r2"))
    return rounded(a.best_run(r))


@query("benjamini_hochberg", f"""WITH p AS (SELECT c_custkey AS id, c_nationkey, abs(c_acctbal) / 10000 AS p FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM p)
    SELECT id, {R('least(1, min(p * m / r) OVER (ORDER BY r DESC))')} AS fdr FROM r""")
def _(t: Tables):
    p = t.customer.select(F.col("c_custkey").alias("id"), (F.abs("c_acctbal") / 10000).alias("p"))
    return rounded(a.benjamini_hochberg(p).select("id", "fdr"))


_TARGETS = ["BUILDING", "HOUSEHOLD", "no such set", "AUTOMOBILE"]


@query("set_enrichment_slices", f"""WITH f AS (SELECT c_mktsegment AS s, CASE WHEN c_nationkey < 12 THEN 'fwd' ELSE 'bwd' END AS direction, min(abs(c_acctbal)) / 10000 AS fdr FROM customer GROUP BY 1, 2),
    o AS (SELECT unnest(['BUILDING', 'HOUSEHOLD', 'no such set', 'AUTOMOBILE']) AS s, unnest([0, 1, 2, 3]) AS slot)
    SELECT s AS set_name, slot, {R('max(-log10(greatest(fdr, 1e-40))) FILTER (direction = $$fwd$$)')} AS fwd, {R('max(-log10(greatest(fdr, 1e-40))) FILTER (direction = $$bwd$$)')} AS bwd FROM o LEFT JOIN f USING (s) GROUP BY 1, 2""".replace("$$", "'"))
def _(t: Tables):
    f = t.customer.groupBy(F.col("c_mktsegment").alias("set_name"), F.when(F.col("c_nationkey") < 12, "fwd").otherwise("bwd").alias("direction")).agg((F.min(F.abs("c_acctbal")) / 10000).alias("fdr"))
    s = a.set_enrichment_slices(f, _TARGETS)
    return rounded(s.groupBy("set_name", "slot").pivot("direction", ["fwd", "bwd"]).agg(F.max("neglog10_fdr")))
