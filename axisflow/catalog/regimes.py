"""Branches, regimes, clustering and label agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as c
from ..operators import regimes as rg
from .base import R, Tables, query, rounded, with_


@query("assign_branches", with_("prob", body=f"SELECT cell_id, first(branch ORDER BY prob DESC, branch) AS branch, {R('max(prob)')} AS prob FROM prob GROUP BY 1 HAVING max(prob) >= 0.3"))
def _(t: Tables):
    return rounded(rg.assign_branches(t.prob, 0.3))


@query("branches_from_masks", "SELECT s_suppkey AS cell_id, 'rich' AS branch FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT s_suppkey, 'near' FROM supplier WHERE s_nationkey < 10")
def _(t: Tables):
    df = t.supplier.select(F.col("s_suppkey").alias("cell_id"), (F.col("s_acctbal") > 5000).alias("rich"), (F.col("s_nationkey") < 10).alias("near"))
    return rg.branches_from_masks(df, ["rich", "near"])


@query("branches_from_labels", "SELECT c_custkey AS cell_id, c_mktsegment AS branch FROM customer")
def _(t: Tables):
    return rg.branches_from_labels(t.customer.withColumnRenamed("c_custkey", "cell_id"), "c_mktsegment")


@query("min_branch_size", "SELECT c_nationkey AS branch, count(*) AS n, count(*) >= 60 AS kept FROM customer GROUP BY 1")
def _(t: Tables):
    kept, dropped = rg.min_branch_size(t.customer.select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("branch")), 60)
    a = kept.groupBy("branch").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(True))
    return a.unionByName(dropped.withColumn("kept", F.lit(False)))


@query("dominant_branch_weight", with_("prob", body=f"SELECT cell_id, branch, {R('prob')} AS w FROM prob WHERE branch = (SELECT arg_max(branch, m) FROM (SELECT branch, avg(prob) AS m FROM prob GROUP BY 1))"))
def _(t: Tables):
    return rounded(rg.dominant_branch_weight(t.prob))


@query("classify_regime", with_("reg", body="SELECT cell_id, regime FROM reg"))
def _(t: Tables):
    return t.reg.select("cell_id", "regime")


_CONF = """greatest(0, least(1, CASE regime WHEN 'unstable' THEN (lambda_max - 0.1) / 0.1 WHEN 'deeply_stable' THEN (-1.0 - lambda_min) / 1.0
    WHEN 'plastic' THEN (plasticity - 0.3) / 0.7 ELSE (0.1 - lambda_max) / 0.1 END))"""


@query("regime_confidence", with_("reg", body=f"SELECT cell_id, regime, {R(_CONF)} AS confidence FROM reg"))
def _(t: Tables):
    return rounded(rg.regime_confidence(t.reg).select("cell_id", "regime", "confidence"))


_M = ", ".join(f"{R(f'avg({m})')} AS {m}_mean, {R(f'stddev_pop({m})')} AS {m}_std" for m in rg.METRICS)


@query("regime_stats", with_("reg", body=f"SELECT regime, count(*) AS n, {_M}, {R('count(*) / (SELECT count(*) FROM reg)')} AS fraction FROM reg GROUP BY 1"))
def _(t: Tables):
    return rounded(rg.regime_stats(t.reg))


_CNT = ", ".join(f"count(*) FILTER (regime = '{r}') AS {r}, {R(f'''count(*) FILTER (regime = '{r}') / count(*)''')} AS {r}_fraction" for r in rg.REGIMES)


@query("compare_regimes", with_("reg", body=f"SELECT condition, count(*) AS total, {_CNT} FROM reg GROUP BY 1"))
def _(t: Tables):
    return rounded(rg.compare_regimes(t.reg, "condition"))


@query("compare_regimes_by_cell_type", with_("reg", body=f"SELECT cell_type, condition, count(*) AS total, {_CNT} FROM reg GROUP BY GROUPING SETS ((condition), (cell_type, condition))"))
def _(t: Tables):
    return rounded(rg.compare_regimes(t.reg, "condition", "cell_type"))


@query("regime_diversity", with_("reg", body=f"""SELECT cell_type, sum(n)::BIGINT AS n_rows, count(*) AS n_regimes, {R('sum(-n / tot * log2(n / tot + 1e-10))')} AS entropy, string_agg(regime || '=' || n::VARCHAR, ',' ORDER BY regime) AS distribution
    FROM (SELECT cell_type, regime, count(*) AS n, sum(count(*)) OVER (PARTITION BY cell_type) AS tot FROM reg GROUP BY 1, 2) GROUP BY 1"""))
def _(t: Tables):
    d = rg.regime_diversity(t.reg, "cell_type")
    text = F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rounded(d.withColumn("distribution", text))


@query("build_atlas", with_("embt", extra={"m": """SELECT cell_id, cluster, (t - (SELECT min(t) FROM embt)) / ((SELECT max(t) - min(t) FROM embt) + 1e-8) AS t, list_max(re) AS lambda_max, list_min(re) AS lambda_min, len([v for v in re if abs(v) < 0.1]) / 32e0 AS plasticity,
    len([v for v in re if v < 0])::DOUBLE AS stable_dim FROM (SELECT *, [v * 0.9e0 for v in x[1:32]] AS re FROM embt)""", "reg": """SELECT *, CASE WHEN lambda_max > 0.3 THEN 'unstable' WHEN lambda_min < -0.3 THEN 'deeply_stable'
        WHEN abs(lambda_max) < 0.05 AND plasticity > 0.3 THEN 'plastic' ELSE 'stable' END AS regime FROM m"""},
    body=f"""SELECT cell_id, {R('t')} AS t, {R('lambda_max')} AS lambda_max, {R('lambda_min')} AS lambda_min, {R('plasticity')} AS plasticity, stable_dim, regime,
    {R('''greatest(0, least(1, CASE regime WHEN 'unstable' THEN (lambda_max - 0.3) / 0.3 WHEN 'deeply_stable' THEN (-0.3 - lambda_min) / 0.3 WHEN 'plastic' THEN (plasticity - 0.3) / 0.7 ELSE (0.3 - lambda_max) / 0.3 END))''')} AS confidence FROM reg"""))
def _(t: Tables):
    from ..plans.atlas import atlas_from_spectra
    spectra = t.embt.select("cell_id", "t", F.transform(F.slice("x", 1, 32), lambda v: v * 0.9).alias("re"))
    return rounded(atlas_from_spectra(spectra, tau=0.3, deep=-0.3).drop("re"))


@query("atlas_from_operators")
def _(t: Tables):
    from ..plans.atlas import build_atlas
    atlas = build_atlas(t.embt.select("cell_id", "t", F.col("cluster").alias("cell_type"), F.col("x").alias("j")), 8, eps=0.1)
    return rounded(rg.regime_stats(atlas))


@query("operator_features", with_("met", body="SELECT cell_id, " + ", ".join(f"{R(f'({m} - (SELECT avg({m}) FROM met)) / (SELECT stddev_pop({m}) FROM met)')} AS {m}" for m in rg.METRICS) + " FROM met"))
def _(t: Tables):
    f = c.operator_features(t.met)
    return rounded(f.select("cell_id", *[F.col("x")[i].alias(m) for i, m in enumerate(rg.METRICS)]))


_ZF = {"sf": "SELECT i, avg(x[i]) AS m, stddev_pop(x[i]) AS s FROM fold, (SELECT unnest(range(1, 9)) AS i) GROUP BY 1", "zf": "SELECT cell_id, i, (x[i] - m) / s AS z FROM fold, sf"}


@query("joint_space", with_("fold", extra={**_ZF, "so": "SELECT i, avg(x[i] * x[i]) AS m, stddev_pop(x[i] * x[i]) AS s FROM fold, (SELECT unnest(range(1, 9)) AS i) GROUP BY 1", "zo": "SELECT cell_id, i, (x[i] * x[i] - m) / s AS z FROM fold, so"},
    body=f"SELECT cell_id, (i - 1)::INT AS i, {R('0.7e0 * zf.z + 0.3e0 * zo.z')} AS value FROM zf JOIN zo USING (cell_id, i)"))
def _(t: Tables):
    oper = t.fold.select("cell_id", F.transform("x", lambda v: v * v).alias("x"))
    return rounded(c.joint_space(t.fold, oper, 0.3, 8, 8).select("cell_id", F.posexplode("x").alias("i", "value")))


@query("joint_space_unequal", with_("fold", extra={**_ZF, "o": "SELECT cell_id, [x[1] * x[2], x[3]] AS x FROM fold", "so": "SELECT i, avg(x[i]) AS m, stddev_pop(x[i]) AS s FROM o, (SELECT unnest([1, 2]) AS i) GROUP BY 1", "zo": "SELECT cell_id, i, (x[i] - m) / s AS z FROM o, so"},
    body=f"SELECT cell_id, (i - 1)::INT AS i, {R('0.4e0 * z')} AS value FROM zf UNION ALL SELECT cell_id, (i + 7)::INT, {R('0.6e0 * z')} FROM zo"))
def _(t: Tables):
    oper = t.fold.select("cell_id", F.array(F.col("x")[0] * F.col("x")[1], F.col("x")[2]).alias("x"))
    return rounded(c.joint_space(t.fold, oper, 0.6, 8, 2).select("cell_id", F.posexplode("x").alias("i", "value")))


@query("kmeans_clusters")
def _(t: Tables):
    lab = c.kmeans(t.emb, 10)
    return lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("label_propagation")
def _(t: Tables):
    from ..operators.graph import symmetric_graph
    g = symmetric_graph(t.nn.withColumn("w", F.exp(-F.col("dist"))), "w")
    return c.label_propagation(g).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _ari_sql(table: str, a: str, b: str) -> dict[str, str]:
    return {"cn": f"SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {table} GROUP BY 1, 2", "ca": "SELECT a, sum(n) AS n FROM cn GROUP BY 1", "cb": "SELECT b, sum(n) AS n FROM cn GROUP BY 1",
            "tt": "SELECT sum(n) AS t, (SELECT sum(n * (n - 1) / 2) FROM cn) AS p, (SELECT sum(n * (n - 1) / 2) FROM ca) AS pa, (SELECT sum(n * (n - 1) / 2) FROM cb) AS pb FROM cn",
            "mi": "SELECT sum(cn.n / t * ln(cn.n * t / (ca.n * cb.n))) AS mi FROM cn JOIN ca USING (a) JOIN cb USING (b), tt",
            "hh": "SELECT (SELECT -sum(n / t * ln(n / t)) FROM ca, tt) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM cb, tt) AS hb"}


_ARI = "(p - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2))"


@query("ari_nmi", with_(extra=_ari_sql("documents", "lang", "source"), body=f"SELECT {R(_ARI, 9)} AS ari, {R('greatest(mi, 0) / ((ha + hb) / 2)', 9)} AS nmi FROM tt, mi, hh"))
def _(t: Tables):
    return rounded(c.ari_nmi(t.documents, "lang", "source"), 9)


_SIL = {"pr": "SELECT a.cell_id, a.cluster AS own, b.cluster AS l, sum(list_distance(a.x, b.x)) AS s, count(*) AS m FROM emb a JOIN emb b ON true GROUP BY 1, 2, 3",
        "ab": "SELECT cell_id, max(CASE WHEN l = own AND m > 1 THEN s / (m - 1) END) AS a, min(CASE WHEN l <> own THEN s / m END) AS b FROM pr GROUP BY 1"}


@query("silhouette", with_("emb", extra=_SIL, body=f"SELECT {R('avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette, count(*) AS n FROM ab"))
def _(t: Tables):
    return rounded(c.silhouette(t.emb, "cluster", 64))


@query("clustering_report", with_("emb", extra={"half": "SELECT cell_id, cluster, cluster // 2 AS h FROM emb", **_SIL, **_ari_sql("half", "cluster", "h"),
    "pr2": "SELECT a.cell_id, a.cluster // 2 AS own, b.cluster // 2 AS l, sum(list_distance(a.x, b.x)) AS s, count(*) AS m FROM emb a JOIN emb b ON true GROUP BY 1, 2, 3",
    "ab2": "SELECT cell_id, max(CASE WHEN l = own AND m > 1 THEN s / (m - 1) END) AS a, min(CASE WHEN l <> own THEN s / m END) AS b FROM pr2 GROUP BY 1"},
    body=f"""SELECT 'cluster' AS labels, 1e0 AS ari, 1e0 AS nmi, (SELECT {R('avg((b - a) / greatest(a, b))')} FROM ab) AS silhouette, 10::BIGINT AS n_clusters UNION ALL
    SELECT 'h', {R(_ARI)}, {R('mi / ((ha + hb) / 2)')}, (SELECT {R('avg((b - a) / greatest(a, b))')} FROM ab2), 5 FROM tt, mi, hh"""))
def _(t: Tables):
    df = t.emb.withColumn("h", F.floor(F.col("cluster") / 2).cast("int"))
    return rounded(c.clustering_report(df, "cluster", ["cluster", "h"], 64))


@query("alpha_search")
def _(t: Tables):
    oper = t.fold.select("cell_id", F.transform("x", lambda v: v * v).alias("x"))
    truth = t.emb.select("cell_id", F.col("cluster").alias("truth"))
    return rounded(c.alpha_search(t.fold, oper, truth, 10, 8, 8))


_PUR = {"k": "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2", "p": "SELECT source, sum(n)::BIGINT AS size, first(lang ORDER BY n DESC, lang) AS dominant, max(n) / sum(n) AS purity FROM k GROUP BY 1"}


@query("cluster_purity", with_(extra=_PUR, body=f"SELECT source, size, dominant, {R('purity')} AS purity, (SELECT string_agg(lang || '=' || n::VARCHAR, ',' ORDER BY lang) FROM k WHERE k.source = p.source) AS composition FROM p"))
def _(t: Tables):
    d = c.cluster_purity(t.documents, "source", "lang")
    text = F.array_join(F.transform(F.map_entries("composition"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rounded(d.withColumn("composition", text))


@query("overall_purity", with_(extra=_PUR, body=f"SELECT {R('avg(purity)')} AS overall_purity FROM p"))
def _(t: Tables):
    return rounded(c.overall_purity(c.cluster_purity(t.documents, "source", "lang")))


_FATE = {"ft": "SELECT c_custkey AS cell_id, CASE WHEN c_nationkey < 5 THEN 'Progenitor' ELSE c_mktsegment END AS fate FROM customer", "br": "SELECT unnest(['BUILDING', 'MACHINERY']) AS branch"}


def _fates(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("cell_id"), F.when(F.col("c_nationkey") < 5, "Progenitor").otherwise(F.col("c_mktsegment")).alias("fate"))


@query("progenitor_masks", with_(extra=_FATE, body="SELECT cell_id, branch FROM ft JOIN br ON fate = branch OR fate = 'Progenitor'"))
def _(t: Tables):
    return rg.progenitor_masks(_fates(t), ["BUILDING", "MACHINERY"])[0]


@query("progenitor_mask_sizes", with_(extra=_FATE, body=f"SELECT branch, count(*) AS n, {R('count(*) / (SELECT count(*) FROM ft)')} AS share FROM ft JOIN br ON fate = branch OR fate = 'Progenitor' GROUP BY 1"))
def _(t: Tables):
    return rounded(rg.progenitor_masks(_fates(t), ["BUILDING", "MACHINERY"])[1])


@query("crosstab", with_("reg", body=f"SELECT cell_type, regime, count(*) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY cell_type)')} AS share FROM reg GROUP BY 1, 2"))
def _(t: Tables):
    return rounded(rg.crosstab(t.reg, "cell_type", "regime"))


# every branch in one grouped job: branch weights -> windows -> interior peak -> top features
@query("per_branch_peak", with_("ax", extra={"cv": "SELECT event_type AS branch, least(floor(t * 40e0), 39)::INT AS t_idx, (least(floor(t * 40e0), 39)::INT + 0.5e0) / 40e0 AS t, avg(value) AS m FROM ax GROUP BY 1, 2, 3"},
    body=f"""SELECT branch, {R('arg_max(t, m) FILTER (t >= 0.1 AND t <= 0.9)')} AS t, {R('max(m) FILTER (t >= 0.1 AND t <= 0.9)')} AS value, arg_max(t_idx, m) FILTER (t >= 0.1 AND t <= 0.9) AS idx,
    count(*) FILTER (t >= 0.1 AND t <= 0.9) AS n_valid, NULL::DOUBLE AS n_eff_at_peak, arg_max(t, m) < 0.1 OR arg_max(t, m) > 0.9 AS boundary_peak FROM cv GROUP BY 1"""))
def _(t: Tables):
    from ..operators.windows import bin_index, interior_peak
    cv = t.ax.withColumn("t_idx", bin_index("t", 40)).groupBy(F.col("event_type").alias("branch"), "t_idx").agg(F.avg("value").alias("m"))
    return rounded(interior_peak(cv.withColumn("t", (F.col("t_idx") + 0.5) / 40.0), "m", keys=["branch"]))


@query("per_branch_drift")
def _(t: Tables):
    from ..plans.drift import drift_by_branch
    v = F.transform("x", lambda a, i: a * (F.lit(0.5) - F.col("t")) + F.col("x")[(i + 1) % 8] * 0.25)
    cells = t.fold.withColumn("v", v).withColumn("branch", F.when(F.col("cluster") < 5, "low").otherwise("high"))
    load = t.part.select(F.col("p_partkey").cast("string").alias("feature"), F.array(*[F.sin(F.col("p_size") * (i + 1) / 10.0) for i in range(8)]).alias("w"))
    out = drift_by_branch(cells, load, 8, grid=[0.2, 0.35, 0.5, 0.65, 0.8], h=0.15)
    return rounded(out["features"].where(F.col("rank") <= 5), 4)
