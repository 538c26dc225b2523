"""Normalisation, selection, residuals, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep
from .base import R, Tables, query, rounded, vec_long, with_

_NORM = "nrm"
_NORM_SQL = {"nrm": "SELECT cell_id, feature, ln(1e0 + value * 10000e0 / sum(value) OVER (PARTITION BY cell_id)) AS value FROM expr"}


@query("needs_normalising", with_("expr", body="SELECT max(value) AS max_value, max(value) > 50 AS needs_normalising FROM expr"))
def _(t: Tables):
    return prep.needs_normalising(t.expr)


@query("normalize_total_log1p", with_("expr", extra=_NORM_SQL, body=f"SELECT cell_id, feature, {R('value')} AS value FROM nrm"))
def _(t: Tables):
    return rounded(prep.normalize_total(t.expr))


@query("filter_features", with_("expr", body="SELECT feature, count(*) AS n FROM expr GROUP BY 1 HAVING count(*) >= 26"))
def _(t: Tables):
    return prep.filter_features(t.expr, 26).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("highly_variable", with_("expr", extra={**_NORM_SQL,
    "m0": "SELECT feature, sum(value) / n AS mean, sum(value * value) / n - (sum(value) / n) * (sum(value) / n) AS var, n FROM (SELECT cell_id, feature, exp(value) - 1 AS value FROM nrm), (SELECT count(DISTINCT cell_id)::DOUBLE AS n FROM expr) GROUP BY feature, n",
    "m1": "SELECT feature, ln(1 + mean) AS mean, ln((var * n / (n - 1) + 1e-12) / mean) AS dispersion FROM m0 WHERE mean > 0",
    "m2": "SELECT *, least(greatest(ceil((mean - (SELECT min(mean) FROM m1)) / (((SELECT max(mean) FROM m1) - (SELECT min(mean) FROM m1) + 1e-12) / 20e0)) - 1, 0), 19) AS bin FROM m1",
    "b": "SELECT bin, avg(dispersion) AS bm, stddev_samp(dispersion) AS bs, count(*) AS bn FROM m2 GROUP BY 1",
    "z": "SELECT feature, mean, dispersion, CASE WHEN bn = 1 THEN 1e0 WHEN bs > 0 THEN (dispersion - bm) / bs ELSE 0e0 END AS score FROM m2 JOIN b USING (bin)"},
    body=f"SELECT feature, {R('mean')} AS mean, {R('dispersion')} AS dispersion, {R('score')} AS score, row_number() OVER (ORDER BY round(score, 9) DESC, feature)::INT AS rank FROM z QUALIFY rank <= 200"))
def _(t: Tables):
    return rounded(prep.highly_variable(prep.normalize_total(t.expr), 200, t.n_cells.cast("double")))


@query("tfidf", with_("expr", extra={"n": "SELECT count(DISTINCT cell_id)::DOUBLE AS n FROM expr", "d": "SELECT feature, count(*) AS df FROM expr GROUP BY 1"},
    body=f"SELECT cell_id, feature, {R('ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * ln(1 + n / (1 + df)) * 10000e0)')} AS value FROM expr JOIN d USING (feature), n"))
def _(t: Tables):
    return rounded(prep.tfidf(t.expr, t.n_cells))


@query("top_variable", with_("expr", extra=_NORM_SQL, body=f"""SELECT feature, {R('var')} AS var, row_number() OVER (ORDER BY var DESC, feature)::INT AS rank FROM
    (SELECT feature, sum(value * value) / n - (sum(value) / n) * (sum(value) / n) AS var FROM nrm, (SELECT count(DISTINCT cell_id)::DOUBLE AS n FROM expr) GROUP BY feature, n) QUALIFY rank <= 100"""))
def _(t: Tables):
    return rounded(prep.top_variable(prep.normalize_total(t.expr), 100, t.n_cells))


@query("row_depth", with_("expr", body=f"""SELECT {R('quantile_cont(d, 0.25)')} AS q25, {R('quantile_cont(d, 0.5)')} AS median, {R('quantile_cont(d, 0.75)')} AS q75
    FROM (SELECT cell_id, sum(value) AS d FROM expr GROUP BY 1)"""))
def _(t: Tables):
    return rounded(prep.row_depth(t.expr))


def _phase_sets(t: Tables):
    s = t.part.where(F.col("p_brand") == "Brand#3").select(F.lit("S").alias("set_name"), F.col("p_partkey").alias("feature"))
    g = t.part.where(F.col("p_brand") == "Brand#9").select(F.lit("G2M").alias("set_name"), F.col("p_partkey").alias("feature"))
    return s.union(g)


@query("gene_set_score")
def _(t: Tables):
    return rounded(prep.gene_set_score(prep.normalize_total(t.expr), _phase_sets(t)))


@query("gene_set_phase")
def _(t: Tables):
    return rounded(prep.phase_label(prep.gene_set_score(prep.normalize_total(t.expr), _phase_sets(t))))


# with the control drawn from the whole bin nothing depends on the hash, so the core can be compared
@query("gene_set_score_full_control", with_("expr", extra={**_NORM_SQL, "mean0": "SELECT feature, sum(value) AS m FROM nrm GROUP BY 1",
    "bins": "SELECT a.feature, least(floor((SELECT count(*) FROM mean0 b WHERE b.m < a.m) * 5 / (SELECT count(*) FROM mean0)), 4) AS bin FROM mean0 a",
    "sets": "SELECT 'S' AS set_name, p_partkey AS feature FROM part WHERE p_brand = 'Brand#3'",
    "ins": "SELECT feature, bin FROM bins JOIN sets USING (feature)",
    "ctl": "SELECT feature FROM bins WHERE bin IN (SELECT bin FROM ins) AND feature NOT IN (SELECT feature FROM sets)"},
    body=f"""SELECT cell_id, 'S' AS set_name, {R('vs / ns - vc / nc')} AS score FROM (SELECT cell_id, sum(CASE WHEN i.feature IS NOT NULL THEN value ELSE 0 END) AS vs,
    sum(CASE WHEN c.feature IS NOT NULL THEN value ELSE 0 END) AS vc FROM nrm LEFT JOIN ins i ON i.feature = nrm.feature LEFT JOIN ctl c ON c.feature = nrm.feature
    GROUP BY 1), (SELECT count(*) AS ns FROM ins), (SELECT count(*) AS nc FROM ctl)"""))
def _(t: Tables):
    sets = t.part.where(F.col("p_brand") == "Brand#3").select(F.lit("S").alias("set_name"), F.col("p_partkey").alias("feature"))
    return rounded(prep.gene_set_score(prep.normalize_total(t.expr), sets, n_bins=5, ctrl_size=10**9))


@query("residualise_one", f"""WITH b AS (SELECT regr_slope(l_extendedprice / 1000e0, l_quantity) AS s, regr_intercept(l_extendedprice / 1000e0, l_quantity) AS i FROM lineitem)
    SELECT l_orderkey, l_linenumber, {R('l_extendedprice / 1000e0 - (i + s * l_quantity)')} AS y_resid FROM lineitem, b""")
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000.0).alias("y"))
    return rounded(prep.residualise_one(df, "y", "l_quantity").select("l_orderkey", "l_linenumber", "y_resid"))


# two covariates: the closed form of the partialled regression, written with covariances
@query("residualise_variance", f"""WITH c AS (SELECT l_extendedprice / 1000e0 AS y, l_quantity AS a, l_discount AS b FROM lineitem),
    m AS (SELECT var_pop(y) AS vy, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb FROM c)
    SELECT {R('(ya * (ya * vb - yb * ab) + yb * (yb * va - ya * ab)) / ((va * vb - ab * ab) * vy)')} AS removed FROM m""")
def _(t: Tables):
    df = t.lineitem.select((F.col("l_extendedprice") / 1000.0).alias("y"), "l_quantity", "l_discount")
    _, removed = prep.residualise(df, ["y"], ["l_quantity", "l_discount"])
    return rounded(df.limit(1).select(F.lit(float(removed["y"])).alias("removed")))


@query("standardize", f"""SELECT l_orderkey, l_linenumber, {R('(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem)')} AS l_quantity,
    {R('(l_discount - (SELECT avg(l_discount) FROM lineitem)) / (SELECT stddev_pop(l_discount) FROM lineitem)')} AS l_discount FROM lineitem""")
def _(t: Tables):
    return rounded(prep.standardize(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"]))


@query("balance_blocks", with_("fold", body=f"""SELECT cell_id, i::INT AS i, {R('z[i + 1]')} AS value FROM (SELECT cell_id, list_concat([v / sqrt(64e0) for v in e.x], [v / sqrt(8e0) for v in f.x]) AS z
    FROM emb e JOIN fold f USING (cell_id)), (SELECT unnest(range(72)) AS i)"""))
def _(t: Tables):
    return rounded(vec_long(prep.balance_blocks(t.emb, t.fold, 64, 8), "x", "cell_id"))


@query("pca_fit")
def _(t: Tables):
    model = prep.fit_pca(t.emb, 64, 5)
    z = prep.pca_encode(t.emb, model)
    return rounded(z.agg(*[F.var_pop(F.col("z")[i]).alias(f"var{i}") for i in range(5)], *[F.abs(F.avg(F.col("z")[i])).alias(f"mean{i}") for i in range(5)]))


def _given_model():
    import numpy as np
    w = np.zeros((2, 8))
    w[0, :4] = 0.5
    w[1, 4:] = 0.5
    return {"mean": np.full(8, 0.01), "components": w}


_Z = "[list_sum([(v - 0.01e0) * 0.5e0 for v in x[1:4]]), list_sum([(v - 0.01e0) * 0.5e0 for v in x[5:8]])]"


@query("pca_encode_given", with_("fold", body=f"SELECT cell_id, i::INT AS i, {R('z[i + 1]')} AS value FROM (SELECT cell_id, {_Z} AS z FROM fold), (SELECT unnest([0, 1]) AS i)"))
def _(t: Tables):
    return rounded(vec_long(prep.pca_encode(t.fold, _given_model()), "z", "cell_id"))


@query("reconstruction_error", with_("fold", body=f"""SELECT {R('avg((x[i] - (CASE WHEN i <= 4 THEN z[1] ELSE z[2] END * 0.5e0 + 0.01e0)) ** 2)', 9)} AS mse FROM
    (SELECT x, {_Z} AS z FROM fold), (SELECT unnest(range(1, 9)) AS i)"""))
def _(t: Tables):
    m = _given_model()
    return rounded(prep.reconstruction_error(prep.pca_decode(prep.pca_encode(t.fold, m), m)), 9)


def _loadings(t: Tables):
    return t.part.select(F.col("p_brand").alias("factor"), F.col("p_type").alias("modality"), F.col("p_partkey").alias("feature"),
                         (F.col("p_retailprice") / 1000.0 - F.col("p_size") / 20.0).alias("w"))


_LOAD = {"ld": "SELECT p_brand AS factor, p_type AS modality, p_partkey AS feature, p_retailprice / 1000e0 - p_size / 20e0 AS w FROM part"}


@query("factor_contribution", with_(extra=_LOAD, body=f"SELECT factor, modality, {R('sum(w * w) / sum(sum(w * w)) OVER (PARTITION BY factor)')} AS share FROM ld GROUP BY 1, 2"))
def _(t: Tables):
    return rounded(prep.factor_contribution(_loadings(t)))


@query("top_loadings", with_(extra=_LOAD, body=f"SELECT factor, modality, feature, {R('w')} AS w, row_number() OVER (PARTITION BY factor, modality ORDER BY abs(w) DESC, feature)::INT AS rank FROM ld QUALIFY rank <= 5"))
def _(t: Tables):
    return rounded(prep.top_loadings(_loadings(t), 5))


@query("minmax01_impute", f"""WITH v AS (SELECT event_id, CASE WHEN value <= 400 THEN value END AS v FROM events)
    SELECT event_id, {R('(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM v)) - (SELECT min(v) FROM v)) / ((SELECT max(v) FROM v) - (SELECT min(v) FROM v) + 1e-8)')} AS v FROM v""")
def _(t: Tables):
    df = t.events.select("event_id", F.when(F.col("value") <= 400, F.col("value")).alias("v"))
    return rounded(prep.minmax01(df, "v"))


@query("rank01", f"SELECT event_id, {R('percent_rank() OVER (ORDER BY value)')} AS rank01 FROM events")
def _(t: Tables):
    return rounded(prep.rank01(t.events.select("event_id", "value"), "value").select("event_id", "rank01"))


@query("noisy_rank01")
def _(t: Tables):
    out = prep.noisy_rank01(t.ax.select("cell_id", "t"), "t", "cell_id", 0.05)
    return rounded(out.agg(F.corr("t", "rank01").alias("r"), F.count(F.lit(1)).alias("n"), F.max("rank01").alias("hi")))


@query("identify_tfs", "SELECT p_partkey AS feature FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def _(t: Tables):
    lst = t.lineitem.where(F.col("l_quantity") >= 50).select(F.col("l_partkey").alias("feature"))
    return prep.identify_tfs(t.part.select(F.col("p_partkey").alias("feature")), lst)


@query("population_select", with_("ax", body="""SELECT cell_id, CASE WHEN t <= (SELECT quantile_cont(t, 0.2) FROM ax) THEN 'source'
    WHEN t >= (SELECT quantile_cont(t, 0.8) FROM ax) THEN 'target' ELSE 'transit' END AS role FROM ax"""))
def _(t: Tables):
    return prep.population_select(t.ax).select("cell_id", "role")


@query("population_by_label", "SELECT event_id AS cell_id, CASE event_type WHEN 'signup' THEN 'source' WHEN 'purchase' THEN 'target' ELSE 'transit' END AS role FROM events")
def _(t: Tables):
    return prep.population_by_label(t.ax, "event_type", "signup", "purchase").select("cell_id", "role")


@query("binary_axis", "SELECT event_id AS cell_id, CASE WHEN event_type = 'signup' THEN 0e0 ELSE 1e0 END AS axis FROM events")
def _(t: Tables):
    return prep.binary_axis(t.ax, "event_type", "signup", "axis").select("cell_id", "axis")


@query("label_match_branches", """SELECT c_custkey AS cell_id, b.branch FROM customer JOIN (VALUES ('one', 'machin'), ('one', 'auto'), ('two', 'build'), ('two', 'a'), ('three', 'house')) b(branch, term)
    ON contains(lower(c_mktsegment), b.term) GROUP BY 1, 2""")
def _(t: Tables):
    cells = t.customer.select(F.col("c_custkey").alias("cell_id"), "c_mktsegment")
    return prep.label_match_branches(cells, "c_mktsegment", {"one": ["machin", "auto"], "two": ["build", "A"], "three": ["house"]})


@query("ridge_loadings")
def _(t: Tables):
    lat = t.supplier.select(F.col("s_suppkey").alias("cell_id"), F.array(F.col("s_acctbal") / 10000.0, F.col("s_nationkey") / 25.0).alias("x"))
    return rounded(vec_long(prep.ridge_loadings(lat, t.expr, 2), "w", "feature", value="w"))


# with one latent dimension the ridge solution is a ratio of centred sums
@query("ridge_loadings_1d", with_("expr", extra={"lat": "SELECT s_suppkey AS cell_id, s_acctbal / 10000e0 AS x FROM supplier"},
    body=f"""SELECT feature, {R('(sum(x * value) - (SELECT avg(x) FROM lat) * sum(value)) / ((SELECT var_pop(x) * count(*) FROM lat) + 1e0)')} AS w FROM expr JOIN lat USING (cell_id) GROUP BY 1"""))
def _(t: Tables):
    lat = t.supplier.select(F.col("s_suppkey").alias("cell_id"), F.array(F.col("s_acctbal") / 10000.0).alias("x"))
    out = prep.ridge_loadings(lat, t.expr, 1)
    return rounded(out.select("feature", F.col("w")[0].alias("w")))


@query("fate_label", with_("prob", extra={"e": "SELECT cell_id, max_by(branch, prob) AS branch, sum(CASE WHEN prob > 0 THEN -prob * ln(prob) ELSE 0 END) AS entropy FROM prob GROUP BY 1"},
    body=f"SELECT cell_id, {R('entropy')} AS entropy, CASE WHEN entropy >= (SELECT quantile_cont(entropy, 0.75) FROM e) THEN 'Progenitor' ELSE branch END AS fate FROM e"))
def _(t: Tables):
    return rounded(prep.fate_label(t.prob))


@query("force_include", with_("expr", body="""SELECT feature, bool_and(promoted) AS promoted FROM (SELECT p_partkey AS feature, false AS promoted FROM part WHERE p_retailprice > 1000
    UNION ALL SELECT p_partkey, true FROM part WHERE p_brand = 'Brand#5' AND p_partkey IN (SELECT feature FROM expr)) GROUP BY 1"""))
def _(t: Tables):
    sel = t.part.where(F.col("p_retailprice") > 1000).select(F.col("p_partkey").alias("feature"))
    panel = t.part.where(F.col("p_brand") == "Brand#5").select(F.col("p_partkey").alias("feature"))
    return prep.force_include(sel, panel, t.expr)


@query("fate_from_day", with_("ax", body="""SELECT cell_id, CASE WHEN t * 30 <= 6.5 THEN 'Progenitor' WHEN event_type IN ('click', 'view') THEN event_type ELSE 'Other' END AS fate FROM ax"""))
def _(t: Tables):
    df = t.ax.withColumn("day", F.col("t") * 30)
    return prep.fate_from_day(df, ["click", "view"], "day", "event_type", 6.5).select("cell_id", "fate")


@query("terminal_pure", with_("prob", body=f"""SELECT branch, cell_id, {R('prob')} AS prob FROM prob JOIN (SELECT branch, quantile_cont(prob, 0.9) AS cut FROM prob GROUP BY 1) USING (branch) WHERE prob >= cut"""))
def _(t: Tables):
    return rounded(prep.terminal_pure(t.prob, 0.9).select("branch", "cell_id", "prob"))
