"""Regulator scoring against the supplier -> part network."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regulators as rg
from ..operators import spectra as sp
from ..operators import windows as w
from .base import R, Tables, query, rounded, with_
from .spectra import _BR, bridge_inputs

_FS = {"ns": "SELECT count(*) AS n FROM lamp WHERE lam > 0.0", "fs": "SELECT feature, sum(abs(score)) / any_value(n) AS score FROM trackp, ns WHERE t_idx IN (SELECT t_idx FROM lamp WHERE lam > 0.0) GROUP BY 1"}


@query("feature_scores", with_("trackp", "lamp", extra=_FS, body=f"SELECT feature, {R('score')} AS score FROM fs"))
def _(t: Tables):
    return rounded(rg.feature_scores(t.trackp, t.lamp, thr=0.0))


@query("feature_scores_fallback", with_("trackp", "lamp", "gs", body=f"SELECT feature, {R('score')} AS score FROM gs"))
def _(t: Tables):
    # no t is sensitive at this cut-off, so the stored list is used
    return rounded(rg.feature_scores(t.trackp, t.lamp, stored=t.gs, thr=1e9))


@query("bridge_feature_scores", with_("track", "lam", "act", extra={**_BR, "s": "SELECT direction, t_idx FROM bl WHERE lam > 0.05", "n": "SELECT direction, count(*) AS n FROM s GROUP BY 1",
    "p": "SELECT direction, feature, sum(abs(score)) / any_value(n) AS b FROM bt JOIN s USING (direction, t_idx) JOIN n USING (direction) GROUP BY 1, 2", "a": "SELECT direction, feature, avg(sc) AS a FROM br GROUP BY 1, 2"},
    body=f"SELECT direction, feature, {R('greatest(a, b)')} AS score FROM a FULL JOIN p USING (direction, feature)"))
def _(t: Tables):
    track, act, lam = bridge_inputs(t)
    table = sp.bridge_feature_table(track, act, lam, 10, act_thr=0.95)
    return rounded(rg.bridge_feature_scores(table, track, lam))


_SH = {"sh": "SELECT source, target, weight, abs(score) AS score, abs(score) * abs(weight) AS c FROM net JOIN gs ON feature = target"}
_RS = {"rs": "SELECT source AS regulator, sum(c) AS weighted_score, avg(score) AS mean_score, avg(abs(weight)) AS db_confidence, count(*) AS n_edges FROM sh GROUP BY 1 HAVING count(*) >= 3"}


@query("regulator_scores", with_("net", "gs", extra={**_SH, **_RS}, body=f"SELECT regulator, {R('weighted_score')} AS weighted_score, {R('mean_score')} AS mean_score, {R('db_confidence')} AS db_confidence, n_edges FROM rs"))
def _(t: Tables):
    return rounded(rg.regulator_scores(t.gs, t.net))


def _enrich(scores: str = "gs") -> dict[str, str]:
    return {"u": f"SELECT feature AS target, CASE WHEN abs(score) >= (SELECT quantile_cont(abs(score), 0.75) FROM {scores}) THEN 1 ELSE 0 END AS top FROM {scores} WHERE feature IN (SELECT target FROM net)",
            "sz": "SELECT count(*)::BIGINT AS nt, sum(top)::BIGINT AS np FROM u",
            "pe": "SELECT source AS regulator, count(*)::BIGINT AS n_targets, sum(top)::BIGINT AS n_in_top, any_value(nt) AS n_total, any_value(np) AS n_top FROM (SELECT DISTINCT source, target FROM net) JOIN u USING (target), sz GROUP BY 1",
            "tail": """SELECT regulator, n_targets, n_in_top, n_total, n_top, sum(exp(lgamma(n_top + 1) - lgamma(x + 1) - lgamma(n_top - x + 1) + lgamma(n_total - n_top + 1) - lgamma(n_targets - x + 1)
                - lgamma(n_total - n_top - n_targets + x + 1) - lgamma(n_total + 1) + lgamma(n_targets + 1) + lgamma(n_total - n_targets + 1))) AS p
                FROM (SELECT *, unnest(range(n_in_top, least(n_targets, n_top) + 1)) AS x FROM pe) WHERE n_targets - x <= n_total - n_top GROUP BY 1, 2, 3, 4, 5""",
            "en": "SELECT *, least(1e0, p) AS pval, -log10(greatest(least(1e0, p), 1e-10)) AS enrichment FROM tail"}


@query("enrichment", with_("net", "gs", extra=_enrich(), body=f"SELECT regulator, n_targets, n_in_top, n_total, n_top, {R('pval')} AS pval, {R('enrichment')} AS enrichment FROM en"))
def _(t: Tables):
    return rounded(rg.enrichment(t.gs, t.net))


_SPEC = {**_SH, "onk": "SELECT k, t_idx, count(*) OVER (PARTITION BY k) AS non FROM actp WHERE a > 0.5",
         "ft": "SELECT k, feature, sum(abs(score)) AS s, any_value(non) AS non FROM trackp JOIN onk USING (t_idx) GROUP BY 1, 2",
         "ne": "SELECT source AS regulator, count(*) AS ne FROM sh GROUP BY 1",
         "pm": "SELECT source AS regulator, k, sum(s) / (any_value(non) * any_value(ne)) AS m FROM sh JOIN ft ON feature = target JOIN ne ON regulator = source GROUP BY 1, 2",
         "sc": """SELECT regulator, arg_max(k, m) AS peak_archetype, CASE WHEN sum(m) > 0 THEN 1 + sum(m / (tot + 1e-8) * ln(m / (tot + 1e-8) + 1e-8)) / ln((SELECT count(DISTINCT k)::DOUBLE FROM actp)) ELSE 0 END AS specificity
            FROM (SELECT *, sum(m) OVER (PARTITION BY regulator) AS tot FROM pm) GROUP BY 1"""}


@query("archetype_specificity", with_("net", "gs", "trackp", "actp", extra=_SPEC, body=f"SELECT regulator, {R('specificity')} AS specificity, peak_archetype FROM sc"))
def _(t: Tables):
    return rounded(rg.archetype_specificity(t.gs, t.net, t.trackp, t.actp))


# users as features: one user drives all users that share its event type on a given first event
_LL = {"g": "SELECT i::INT AS t_idx, i / 29e0 AS c FROM (SELECT unnest(range(30)) AS i)",
       "nr": "SELECT f, t_idx, c, avg(value) AS mean FROM (SELECT user_id AS f, t_idx, c, value, row_number() OVER (PARTITION BY user_id, t_idx ORDER BY abs(t - c), cell_id) AS rk FROM ax, g) WHERE rk <= 20 GROUP BY 1, 2, 3",
       "pk": "SELECT f, first(c ORDER BY round(mean, 9) DESC, t_idx) AS t FROM nr GROUP BY 1",
       "nt": "SELECT DISTINCT user_id // 10 * 10 AS s, user_id AS tg FROM ax WHERE user_id // 10 * 10 <> user_id"}


@query("lead_lag", with_("ax", extra=_LL, body=f"SELECT s AS regulator, {R('any_value(a.t) - avg(b.t)')} AS lead FROM nt JOIN pk a ON a.f = s JOIN pk b ON b.f = tg GROUP BY 1"))
def _(t: Tables):
    rows = t.ax.select(F.col("user_id").alias("feature"), "cell_id", "t", "value")
    curve = w.nearest_m_mean(rows, keys=["feature"]).withColumn("mean", F.round("mean", 9))  # equal neighbour sets tie
    peaks = w.peak(curve, "mean", ["feature"])
    net = t.ax.select((F.floor(F.col("user_id") / 10) * 10).cast("long").alias("source"), F.col("user_id").alias("target")).distinct().where(F.col("source") != F.col("target"))
    return rounded(rg.lead_lag(peaks.select("feature", "t"), net))


_TOP = {"tc": "SELECT source AS regulator, target, c, row_number() OVER (PARTITION BY source ORDER BY round(c, 12) DESC, target) AS r FROM sh", "tt": "SELECT regulator, string_agg(target::VARCHAR, ', ' ORDER BY r) AS top_targets FROM tc WHERE r <= 8 GROUP BY 1"}


@query("top_contributors", with_("net", "gs", extra={**_SH, **_TOP}, body="SELECT regulator, top_targets FROM tt"))
def _(t: Tables):
    return rg.top_contributors(t.gs, t.net)


@query("ranked_targets", with_("net", "gs", extra={**_SH, **_TOP}, body=f"SELECT regulator, target, {R('c')} AS contribution, r AS position FROM tc"))
def _(t: Tables):
    return rounded(rg.ranked_targets(t.gs, t.net))


_INFER_BODY = f"""SELECT regulator, {R('weighted_score')} AS weighted_score, {R('mean_score')} AS mean_score, {R('db_confidence')} AS db_confidence, n_edges, n_targets, {R('pval')} AS pval, {R('enrichment')} AS enrichment,
    {R('specificity')} AS specificity, peak_archetype, top_targets, row_number() OVER (ORDER BY weighted_score DESC, regulator)::INT AS rank FROM rs JOIN en USING (regulator) JOIN sc USING (regulator) JOIN tt USING (regulator)"""


@query("infer_regulators", with_("net", "gs", "trackp", "actp", extra={**_SPEC, **_RS, **_enrich(), **_TOP}, body=_INFER_BODY))
def _(t: Tables):
    return rounded(rg.infer_regulators(t.gs, t.net, t.trackp, t.actp))


def _branch_scores(t: Tables):
    """Scores by return flag as branch: deviation of the mean discount of a part."""
    return t.lineitem.groupBy(F.col("l_returnflag").alias("branch"), F.col("l_partkey").alias("feature")).agg((F.avg("l_discount") * F.avg("l_quantity") / 10).alias("score"))


_BSC = {"bs": "SELECT l_returnflag AS branch, l_partkey AS feature, avg(l_discount) * avg(l_quantity) / 10 AS score FROM lineitem GROUP BY 1, 2",
        "bsh": "SELECT branch, source, target, weight, abs(score) AS score, abs(score) * abs(weight) AS c FROM net JOIN bs ON feature = target",
        "brs": "SELECT branch, source AS regulator, sum(c) AS ws, avg(score) AS ms, count(*) AS n_edges FROM bsh GROUP BY 1, 2 HAVING count(*) >= 3",
        "bc": "SELECT branch, quantile_cont(abs(score), 0.75) AS cut FROM bs GROUP BY 1",
        "bu": "SELECT branch, feature AS target, CASE WHEN abs(score) >= cut THEN 1 ELSE 0 END AS top FROM bs JOIN bc USING (branch) WHERE feature IN (SELECT target FROM net)",
        "bpe": "SELECT branch, source AS regulator, count(*) AS n_targets, sum(top)::BIGINT AS n_in_top FROM (SELECT DISTINCT source, target FROM net) JOIN bu USING (target) GROUP BY 1, 2"}


@query("infer_regulators_branches", with_("net", extra=_BSC, body=f"""SELECT b.branch, regulator, {R('ws')} AS weighted_score, {R('ms')} AS mean_score, n_edges, n_targets,
    CASE WHEN regulator IS NOT NULL THEN row_number() OVER (PARTITION BY b.branch ORDER BY ws DESC, regulator)::INT END AS rank
    FROM (SELECT DISTINCT branch FROM bs) b LEFT JOIN (SELECT * FROM brs JOIN bpe USING (branch, regulator)) USING (branch)"""))
def _(t: Tables):
    wanted = t.lineitem.select(F.col("l_returnflag").alias("branch")).distinct().union(t.spark.createDataFrame([("unknown",)], "branch string"))
    out = rg.infer_regulators_branches(_branch_scores(t), t.net, wanted)
    return rounded(out.select("branch", "regulator", "weighted_score", "mean_score", "n_edges", "n_targets", "rank"))


@query("filter_regulators", with_("net", "gs", "trackp", "actp", extra={**_SPEC, **_RS, "sz2": "SELECT source AS regulator, count(DISTINCT target) AS n FROM net GROUP BY 1"},
    body=f"""SELECT regulator, {R('weighted_score')} AS weighted_score, {R('specificity')} AS specificity, {R('weighted_score * (1e-6 + specificity)')} AS composite FROM rs JOIN sc USING (regulator) JOIN sz2 USING (regulator)
    WHERE n BETWEEN 500 AND 530 AND specificity >= 1e-6 AND regulator NOT IN ('s1', 's2', 's3') AND regulator IN (SELECT 's' || s_suppkey::VARCHAR FROM supplier WHERE s_acctbal > 0)"""))
def _(t: Tables):
    table = rg.regulator_scores(t.gs, t.net).join(rg.archetype_specificity(t.gs, t.net, t.trackp, t.actp), "regulator")
    keep = t.supplier.where(F.col("s_acctbal") > 0).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("regulator"))
    drop = t.spark.createDataFrame([("S1",), ("s2",), ("S3",)], "regulator string")
    out = rg.filter_regulators(table, t.net, keep, drop, 500, 530, 1e-6)
    return rounded(out.select("regulator", "weighted_score", "specificity", "composite"))


_CO = {"se": "SELECT t_idx FROM lam WHERE lam > 0.05", "tk": "SELECT t_idx, feature, abs(score) AS s, row_number() OVER (PARTITION BY t_idx ORDER BY abs(score) DESC, feature) AS r FROM track JOIN se USING (t_idx) QUALIFY r <= 15",
       "co": "SELECT a.feature AS source, b.feature AS target, sum(least(a.s, b.s)) / (SELECT count(*) FROM se) AS weight FROM tk a JOIN tk b ON a.t_idx = b.t_idx AND a.feature < b.feature GROUP BY 1, 2"}


@query("co_instability_edges", with_("track", "lam", extra=_CO, body=f"SELECT source, target, {R('weight')} AS weight FROM co"))
def _(t: Tables):
    return rounded(rg.co_instability_edges(t.track, t.lam))


_UN = {"un": "SELECT DISTINCT 'u' || (user_id // 10)::VARCHAR AS source, 'u' || user_id::VARCHAR AS target, 1e0 AS weight FROM ax",
       "fsu": "SELECT feature, sum(abs(score)) / (SELECT count(*) FROM se) AS score FROM track JOIN se USING (t_idx) GROUP BY 1",
       "rg": "SELECT DISTINCT source FROM un", "tg": "SELECT feature AS target FROM fsu ORDER BY score DESC, feature LIMIT 60", "nd": "SELECT source AS n FROM rg UNION SELECT target FROM tg"}


@query("hybrid_edges", with_("ax", "track", "lam", extra={**_CO, **_UN}, body=f"""SELECT q.source, q.target, {R('weight')} AS weight, type, {R('coalesce(score, 0.01)')} AS target_score FROM (
    SELECT source, target, weight, 'reference' AS type FROM un WHERE target IN (SELECT target FROM tg) UNION ALL
    SELECT source, target, weight, 'denovo' FROM co WHERE source IN (SELECT n FROM nd) AND target IN (SELECT n FROM nd) AND NOT EXISTS (SELECT 1 FROM un WHERE un.source = co.source AND un.target = co.target)) q
    LEFT JOIN fsu ON feature = q.target"""))
def _(t: Tables):
    u = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    net = t.ax.select(F.concat(F.lit("u"), F.floor(F.col("user_id") / 10).cast("string")).alias("source"), u.alias("target"), F.lit(1.0).alias("weight")).distinct()
    scores = rg.feature_scores(t.track, t.lam)
    top = scores.orderBy(F.col("score").desc(), "feature").limit(60).select(F.col("feature").alias("target"))
    return rounded(rg.hybrid_edges(net, rg.co_instability_edges(t.track, t.lam), net.select(F.col("source").alias("regulator")).distinct(), top, scores))


_K = ["A", "N", "R"]


@query("regulator_by_archetype", with_("net", "gs", "trackp", "actp", extra={
    "onk": "SELECT k, t_idx, count(*) OVER (PARTITION BY k) AS non FROM (SELECT k, t_idx FROM actp JOIN (SELECT k, quantile_cont(a, 0.75) AS c FROM actp GROUP BY 1) USING (k) WHERE a >= c)",
    "ft": "SELECT k, feature, sum(abs(score)) / any_value(non) AS m FROM trackp JOIN onk USING (t_idx) GROUP BY 1, 2"},
    body="SELECT source AS regulator, " + ", ".join(R(f"coalesce(avg(m) FILTER (k = '{k}'), 0e0)") + f' AS "{k}"' for k in _K) + " FROM net JOIN ft ON feature = target GROUP BY 1"))
def _(t: Tables):
    every = t.actp.select("t_idx").distinct().withColumn("lam", F.lit(1.0))
    return rounded(rg.regulator_by_archetype(t.net, sp.archetype_feature_score(t.trackp, t.actp, every), _K))


@query("regulator_profiles", with_("net", "gs", "trackp", "actp", extra={**_SPEC, "cv": "SELECT source AS regulator, t_idx, avg(abs(t.score)) AS ts FROM net JOIN trackp t ON feature = target GROUP BY 1, 2"},
    body=f"SELECT regulator, t_idx, {R('ts')} AS target_score, peak_archetype, {R('a')} AS a FROM cv JOIN sc USING (regulator) LEFT JOIN actp ON k = peak_archetype AND actp.t_idx = cv.t_idx".replace("SELECT regulator, t_idx", "SELECT regulator, cv.t_idx")))
def _(t: Tables):
    spec = rg.archetype_specificity(t.gs, t.net, t.trackp, t.actp)
    contrib = t.net.select(F.col("source").alias("regulator"), "target")
    return rounded(rg.regulator_profiles(contrib, t.trackp, t.actp, spec))


@query("quality_breadth", with_("net", "gs", extra={**_SH, **_RS}, body=f"SELECT regulator, n_edges, {R('mean_score')} AS mean_score, {R('(weighted_score - (SELECT min(weighted_score) FROM rs)) / ((SELECT max(weighted_score) - min(weighted_score) FROM rs) + 1e-8)')} AS size FROM rs"))
def _(t: Tables):
    return rounded(rg.quality_breadth(rg.regulator_scores(t.gs, t.net)))
