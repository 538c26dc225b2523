"""Resampling, null models, autocorrelation-aware correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nulls as n
from ..operators import windows as w
from ..operators.kernels import bootstrap_curves
from .windows import _draws
from .base import N_T, R, Tables, query, rounded, with_


@query("pair_coordination", with_("act", extra={"r": "SELECT x.k AS k1, y.k AS k2, corr(x.a, y.a) AS r FROM act x JOIN act y USING (t_idx) WHERE x.k < y.k GROUP BY 1, 2"},
    body=f"SELECT {R('avg(CASE WHEN r < -0.5 THEN 1e0 ELSE 0e0 END)')} AS sequential_frac, {R('avg(CASE WHEN r > 0.5 THEN 1e0 ELSE 0e0 END)')} AS concurrent_frac, {R('avg(abs(r))')} AS mean_abs_corr FROM r"))
def _(t: Tables):
    return rounded(n.pair_coordination(t.act))


@query("shuffle_null")
def _(t: Tables):
    from ..plans.null_factor import shuffle_null
    return rounded(shuffle_null(_operator_rows(t), 3, 64))


def _operator_rows(t: Tables):
    cols = [f"v{i}" for i in range(64)]
    rows = t.embt.select("t", *[F.col("x")[i].alias(c) for i, c in enumerate(cols)])
    return w.kernel_smooth(rows, w.linspace(0.05, 0.95, 20), 0.08, values=cols).select("t_idx", "t", F.array(*cols).alias("m"))


_PK = {"pk": "SELECT k, arg_max(t_idx, a) AS t_idx, arg_max(t, a) AS peak, max(a) AS amp, (row_number() OVER (ORDER BY k) - 1)::INT AS ki FROM act GROUP BY 1",
       "pp": "SELECT x.k AS i, y.k AS j, x.peak AS pi_, y.peak AS pj, y.peak - x.peak AS gap FROM pk x JOIN pk y ON x.k < y.k"}


@query("peak_table", with_("act", extra=_PK, body=f"SELECT k, t_idx, {R('peak')} AS peak, {R('amp')} AS amplitude FROM pk"))
def _(t: Tables):
    return rounded(n.peak_table(t.act))


@query("pair_peak_table", with_("act", extra=_PK, body=f"SELECT i, j, {R('pi_')} AS peak_i, {R('pj')} AS peak_j, {R('gap')} AS gap, gap >= 0.055 AS ordered, abs(gap) <= 0.045 AS concurrent FROM pp"))
def _(t: Tables):
    return rounded(n.pair_peak_table(n.peak_table(t.act)))


@query("peak_stats", with_("act", extra=_PK, body=f"""SELECT {R('avg(CASE WHEN gap >= 0.055 THEN 1e0 ELSE 0e0 END)')} AS ordered_prevalence, {R('avg(CASE WHEN abs(gap) <= 0.045 THEN 1e0 ELSE 0e0 END)')} AS concurrent_prevalence,
    {R('coalesce(sum(sign(gap)) / sqrt(count(*) * nullif(count(*) - sum(CASE WHEN gap = 0 THEN 1 ELSE 0 END), 0)::DOUBLE), 0)')} AS kendall_tau, {R('avg(abs(gap))')} AS mean_abs_gap, count(*) AS n_pairs,
    {R('(SELECT min(d) FROM (SELECT peak - lag(peak) OVER (ORDER BY peak) AS d FROM pk))')} AS min_adjacent_gap FROM pp"""))
def _(t: Tables):
    return rounded(n.peak_stats(n.peak_table(t.act)))


_SHIFT = {"shf": "SELECT k, r AS rep, (r * 7 + length(k) * 3)::INT AS s FROM (SELECT DISTINCT k FROM act), (SELECT unnest([0, 1, 2]) AS r)"}


@query("roll_given_shift", with_("act", extra=_SHIFT, body=f"SELECT act.k, rep, ((act.t_idx + s) % 40)::INT AS t_idx, {R('(((act.t_idx + s) % 40) + 0.5e0) / 40e0')} AS t, {R('a')} AS a FROM act JOIN shf USING (k)"))
def _(t: Tables):
    sh = n.replicates(t.act.select("k").distinct(), 3).withColumn("shift", F.col("rep") * 7 + F.length("k") * 3)
    return rounded(n.roll(t.act, sh, N_T).select("k", "rep", "t_idx", "t", "a"))


@query("circular_shift_null")
def _(t: Tables):
    return rounded(n.peak_stats(n.peak_table(n.circular_shift_null(t.act, N_T, 20), ["rep"]), ["rep"]))


@query("peak_resample_null")
def _(t: Tables):
    return rounded(n.peak_stats(n.peak_table(n.peak_resample_null(t.act, N_T, 20), ["rep"]), ["rep"]))


@query("empirical_p", f"""WITH u AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY 1, 2), o AS (SELECT event_type, avg(value) + 1 AS obs FROM events GROUP BY 1)
    SELECT event_type, {R('obs')} AS obs, {R('(1 + sum(CASE WHEN v >= obs THEN 1 ELSE 0 END)) / (1 + count(*))')} AS p_greater, {R('(1 + sum(CASE WHEN v <= obs THEN 1 ELSE 0 END)) / (1 + count(*))')} AS p_less, {R('avg(v)')} AS null_mean,
    {R('stddev_samp(v)')} AS null_sd, {R('quantile_cont(v, 0.05)')} AS q05, {R('quantile_cont(v, 0.5)')} AS q50, {R('quantile_cont(v, 0.95)')} AS q95, count(*) AS n_null, {R('obs / greatest(avg(v), 1e-9)')} AS fold FROM u JOIN o USING (event_type) GROUP BY event_type, obs""")
def _(t: Tables):
    null = t.events.groupBy("event_type", "user_id").agg(F.avg("value").alias("value"))
    obs = t.events.groupBy("event_type").agg((F.avg("value") + 1).alias("value"))
    return rounded(n.empirical_p(null, obs, ["event_type"]))


@query("bootstrap_curves", with_("ax", extra={**_draws(20), "g": "SELECT i::INT AS t_idx, 0.05e0 + 0.9e0 * i / 18 AS g FROM (SELECT unnest(range(19)) AS i)"},
    body=f"""SELECT rep::INT AS rep, t_idx, {R('g')} AS t, {R('sum(m * k * value) / sum(m * k)')} AS mean, {R('sum(m * k) ** 2 / sum(m * k * k)')} AS n_eff
    FROM (SELECT rep, t_idx, g, m, value, exp(-0.5e0 * ((g - t) / 0.05e0) ** 2) AS k FROM bt, g) GROUP BY rep, t_idx, g"""))
def _(t: Tables):
    rows = t.ax.withColumn("value", F.col("value") / 10.0 - 4.5)
    return rounded(bootstrap_curves(rows, w.linspace(0.05, 0.95, 19), 0.05, 20))


@query("bootstrap_correlation", with_("ax", extra={**_draws(20), "g": "SELECT i::INT AS t_idx, 0.05e0 + 0.9e0 * i / 18 AS g FROM (SELECT unnest(range(19)) AS i)",
    "c": "SELECT rep, t_idx, sum(m * k * value) / sum(m * k) AS mean FROM (SELECT rep, t_idx, m, value, exp(-0.5e0 * ((g - t) / 0.05e0) ** 2) AS k FROM bt, g WHERE rep >= 0) GROUP BY rep, t_idx"},
    body=f"SELECT 0 AS g, {R('avg(r)')} AS mean_r FROM (SELECT corr(x.mean, y.mean) AS r FROM c x JOIN c y ON x.t_idx = y.t_idx AND x.rep < y.rep GROUP BY x.rep, y.rep)"))
def _(t: Tables):
    rows = t.ax.withColumn("value", F.col("value") / 10.0 - 4.5)
    c = bootstrap_curves(rows, w.linspace(0.05, 0.95, 19), 0.05, 20).where(F.col("rep") >= 0)
    return rounded(n.mean_pairwise_correlation(c.withColumn("g", F.lit(0)), ["g"], "rep", "t_idx", "mean"))


# given weights: the same curves with a weight that SQL can form
@query("bootstrap_curves_given_weights", with_("ax", extra={"b": "SELECT r AS rep, t, value, ((cell_id * (r + 3)) % 4)::DOUBLE AS w FROM ax, (SELECT unnest([0, 1, 2]) AS r) WHERE (cell_id * (r + 3)) % 4 > 0",
    "g": "SELECT i::INT AS t_idx, 0.05e0 + 0.9e0 * i / 18 AS g FROM (SELECT unnest(range(19)) AS i)", "c": "SELECT rep, t_idx, sum(w * exp(-0.5e0 * ((g - t) / 0.05e0) ** 2) * value) / sum(w * exp(-0.5e0 * ((g - t) / 0.05e0) ** 2)) AS m FROM b, g GROUP BY 1, 2"},
    body=f"SELECT 0 AS g, {R('avg(r)')} AS mean_r FROM (SELECT corr(x.m, y.m) AS r FROM c x JOIN c y ON x.t_idx = y.t_idx AND x.rep < y.rep GROUP BY x.rep, y.rep)"))
def _(t: Tables):
    b = n.replicates(t.ax, 3).withColumn("w", ((F.col("cell_id") * (F.col("rep") + 3)) % 4).cast("double")).where(F.col("w") > 0)
    c = w.kernel_smooth(b, w.linspace(0.05, 0.95, 19), 0.05, "w", ["rep"])
    return rounded(n.mean_pairwise_correlation(c.withColumn("g", F.lit(0)), ["g"], "rep", "t_idx", "mean"))


@query("block_permutation")
def _(t: Tables):
    return rounded(n.block_permutation(t.lam, N_T, 7, 5).select("rep", "t_idx", "lam"))


def _pairs(t: Tables):
    x = t.act.where(F.col("k") == "click").select("t_idx", F.col("a").alias("x"))
    return x.join(t.lam.select("t_idx", F.col("lam").alias("y")), "t_idx")


@query("block_bootstrap_p")
def _(t: Tables):
    return rounded(n.block_bootstrap_p(_pairs(t), N_T, 5, 200))


_SER = {"ser": "SELECT k, t_idx, a AS v FROM act", "l1": "SELECT k, count(*) AS n, corr(v, nx) AS lag1 FROM (SELECT k, t_idx, v, lead(v) OVER (PARTITION BY k ORDER BY t_idx) AS nx FROM ser) GROUP BY 1"}


def _acf(src: str, key: str, out: str) -> dict[str, str]:
    return {f"{out}c": f"SELECT {key}, t_idx, v - avg(v) OVER (PARTITION BY {key}) AS c FROM {src}",
            out: f"SELECT x.{key} AS {key}, lag, sum(x.c * y.c) / (SELECT sum(c * c) FROM {out}c z WHERE z.{key} = x.{key}) AS rho FROM {out}c x, (SELECT unnest(range(0, 11))::INT AS lag), {out}c y WHERE y.{key} = x.{key} AND y.t_idx = x.t_idx + lag GROUP BY 1, 2"}


@query("lag1", with_("act", extra=_SER, body=f"SELECT k, n, {R('lag1')} AS lag1 FROM l1"))
def _(t: Tables):
    return rounded(n.lag1(t.act.withColumnRenamed("a", "v"), ["k"]))


@query("acf", with_("act", extra={**_SER, **_acf("ser", "k", "af")}, body=f"SELECT k, lag, {R('rho')} AS rho FROM af"))
def _(t: Tables):
    return rounded(n.acf(t.act.withColumnRenamed("a", "v"), 10, ["k"]))


_Y = {"sy": "SELECT 'lam' AS tr, t_idx, lam AS v FROM lam", **_acf("sy", "tr", "ay"), "ly": "SELECT corr(v, nx) AS ly FROM (SELECT v, lead(v) OVER (ORDER BY t_idx) AS nx FROM sy)"}
_NE = {**_SER, **_acf("ser", "k", "af"), **_Y, "ab": "SELECT k, af.lag, af.rho AS rx, ay.rho AS ry FROM af JOIN ay USING (lag) WHERE lag >= 1",
       "ct": "SELECT k, coalesce(min(CASE WHEN abs(rx) < 2 / sqrt(40e0) AND abs(ry) < 2 / sqrt(40e0) THEN lag END), 10) AS cut FROM ab GROUP BY 1",
       "nb": "SELECT k, 40e0 / greatest(1 + 2 * sum(CASE WHEN lag <= cut THEN (1 - lag / 40e0) * rx * ry ELSE 0 END), 1 / 40e0) AS nb FROM ab JOIN ct USING (k) GROUP BY 1",
       "na": "SELECT k, n, n * greatest(least((1 - lag1 * ly) / (1 + lag1 * ly + 1e-12), 1e0), 1e0 / n) AS na FROM l1, ly",
       "co": "SELECT k, corr(a, lam) AS r FROM act JOIN lam USING (t_idx) GROUP BY 1"}


@query("neff", with_("act", "lam", extra=_NE, body=f"SELECT k, {R('na')} AS neff_ar1, {R('nb')} AS neff_bartlett FROM na JOIN nb USING (k)"))
def _(t: Tables):
    x = t.act.withColumnRenamed("a", "v")
    y = t.lam.select("t_idx", F.col("lam").alias("v"))
    names = t.act.select("k").distinct()
    ay = n.acf(y, 10).withColumn("k", F.explode(names.agg(F.collect_list("k").alias("k")).scalar()))
    bart = n.neff_bartlett(n.acf(x, 10, ["k"]), ay, N_T, ["k"])
    ly = n.lag1(y).select("lag1").scalar()
    ar = n.lag1(x, ["k"]).select("k", n.neff_ar1(F.col("lag1"), ly, F.col("n")).alias("neff_ar1"))
    return rounded(ar.join(bart.withColumnRenamed("neff", "neff_bartlett"), "k"))


@query("corr_t", with_("act", "lam", extra=_NE, body=f"SELECT k, {R('r')} AS r, {R('r * sqrt((na - 2) / (1 - least(0.999999, r * r)))')} AS t FROM co JOIN na USING (k)"))
def _(t: Tables):
    x = t.act.withColumnRenamed("a", "v")
    ly = n.lag1(t.lam.select("t_idx", F.col("lam").alias("v"))).select("lag1").scalar()
    ar = n.lag1(x, ["k"]).select("k", n.neff_ar1(F.col("lag1"), ly, F.col("n")).alias("na"))
    r = t.act.join(t.lam.select("t_idx", "lam"), "t_idx").groupBy("k").agg(F.corr("a", "lam").alias("r"))
    return rounded(r.join(ar, "k").select("k", "r", n.corr_t(F.col("r"), F.col("na"))[0].alias("t")))


# p for an even number of degrees of freedom has a finite closed form, which checks the continued fraction
@query("t_tail", f"""WITH s AS (SELECT c_custkey AS id, c_acctbal / 2500e0 AS t, 2 * (1 + c_nationkey) AS df FROM customer), th AS (SELECT id, df, abs(t) / sqrt(df) AS z, 1 / (1 + t * t / df) AS c2, abs(t) / sqrt(df + t * t) AS sn FROM s)
    SELECT id, {R('1 - sn * list_sum([exp(lgamma(2 * i + 1) - 2 * lgamma(i + 1) - i * ln(4e0)) * c2 ** i for i in range(df // 2)])')} AS p FROM th""")
def _(t: Tables):
    from ..functions.special import t_two_sided
    s = t.customer.select(F.col("c_custkey").alias("id"), t_two_sided(F.col("c_acctbal") / 2500.0, (2.0 * (1 + F.col("c_nationkey")))).alias("p"))
    return rounded(s)


@query("corrected_correlations", with_("act", "lam", extra=_NE, body=f"SELECT k, 'lam' AS track, {R('r')} AS r, n, {R('na')} AS neff_ar1, {R('nb')} AS neff_bartlett FROM co JOIN na USING (k) JOIN nb USING (k)"))
def _(t: Tables):
    curves = t.act.select(F.lit("all").alias("branch"), "k", "t_idx", "a")
    tracks = t.lam.select(F.lit("all").alias("branch"), F.lit("lam").alias("track"), "t_idx", F.col("lam").alias("v"))
    return rounded(n.corrected_correlations(curves, tracks, N_T, ["branch"]).select("k", "track", "r", "n", "neff_ar1", "neff_bartlett"))


@query("corrected_correlations_p")
def _(t: Tables):
    curves = t.act.select(F.lit("all").alias("branch"), "k", "t_idx", "a")
    tracks = t.lam.select(F.lit("all").alias("branch"), F.lit("lam").alias("track"), "t_idx", F.col("lam").alias("v"))
    return rounded(n.corrected_correlations(curves, tracks, N_T, ["branch"], n_rep=100))


@query("subsample_stability")
def _(t: Tables):
    rows = n.subsample(t.ax, "cell_id", 0.8, 5)
    c = w.bin_curve(rows, 30, ["event_type", "run"]).withColumn("t", (F.col("t_idx") + 0.5) / 30.0)
    pk = w.peak(c.where(F.col("mean").isNotNull()), "mean", ["event_type", "run"])
    return rounded(pk.groupBy("event_type").agg(F.avg("t").alias("mean_peak"), F.stddev_pop("t").alias("std_peak"), F.count(F.lit(1)).alias("runs")))


@query("bootstrap_band", with_("track", body=f"SELECT t_idx, {R('quantile_cont(score, 0.1)')} AS lo, {R('quantile_cont(score, 0.9)')} AS hi FROM track GROUP BY 1"))
def _(t: Tables):
    return rounded(n.bootstrap_band(t.track.withColumnRenamed("score", "v")))
