"""Resampling and null models. Replicates are rows keyed by ``rep``; randomness is hashed from row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing, ranking
from ..functions.special import t_two_sided
from .spectra import activation_correlation


def replicates(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def pair_coordination(act: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Share of archetype pairs with r < -0.5, r > 0.5 and the mean |r|; zeros when there is one archetype."""
    keys = list(keys)
    r = activation_correlation(act, keys)
    pair = F.col("k1") < F.col("k2")
    z = F.lit(0.0)
    share = lambda c: F.coalesce(F.avg(F.when(pair, F.when(c, 1.0).otherwise(0.0))), z)
    return r.groupBy(*keys).agg(share(F.col("r") < -0.5).alias("sequential_frac"), share(F.col("r") > 0.5).alias("concurrent_frac"),
                                F.coalesce(F.avg(F.when(pair, F.abs("r"))), z).alias("mean_abs_corr"))


def null_summary(null: DataFrame, observed: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, population std and one-sided share of null replicates at or above the observation, per metric."""
    n = null.unpivot([], metrics, "metric", "null_value")
    o = observed.unpivot([], metrics, "metric", "observed")
    return (n.join(o, "metric").groupBy("metric", "observed").agg(
        F.avg("null_value").alias("null_mean"), F.stddev_pop("null_value").alias("null_std"),
        F.avg(F.when(F.col("null_value") >= F.col("observed"), 1.0).otherwise(0.0)).alias("p")))


def peak_table(act: DataFrame, keys: list[str] = ()) -> DataFrame:
    """First argmax per archetype: (keys, k, t_idx, peak, amplitude)."""
    b = F.max_by(F.struct("t_idx", "t", "a"), F.struct(F.col("a"), -F.col("t_idx")))
    return act.groupBy(*keys, "k").agg(b.alias("b")).select(*keys, "k", "b.t_idx", F.col("b.t").alias("peak"), F.col("b.a").alias("amplitude"))


def pair_peak_table(peaks: DataFrame, keys: list[str] = (), ordered_gap: float = 0.055, concurrent_gap: float = 0.045) -> DataFrame:
    """Peak gap of each archetype pair i < j with its ordered and concurrent flags (archetypes per key are few)."""
    keys = list(keys)
    a = peaks.select(*keys, F.col("k").alias("i"), F.col("peak").alias("peak_i"))
    b = peaks.select(*keys, F.col("k").alias("j"), F.col("peak").alias("peak_j"))
    j = a.join(b, (keys and [*keys]) or F.lit(True)) if keys else a.withColumn("_", F.lit(1)).join(b.withColumn("_", F.lit(1)), "_").drop("_")
    d = F.col("peak_j") - F.col("peak_i")
    return j.where(F.col("i") < F.col("j")).select(*keys, "i", "j", "peak_i", "peak_j", d.alias("gap"),
                                                   (d >= ordered_gap).alias("ordered"), (F.abs(d) <= concurrent_gap).alias("concurrent"))


def peak_stats(peaks: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Prevalences, Kendall tau-b of archetype index against peak, mean gap, smallest adjacent gap."""
    keys = list(keys)
    p = pair_peak_table(peaks, keys)
    s = F.signum("gap")
    n = F.count(F.lit(1)).cast("double")
    conc, ties = F.sum(s), F.sum(F.when(F.col("gap") == 0, 1.0).otherwise(0.0))
    agg = p.groupBy(*keys).agg(
        F.avg(F.col("ordered").cast("double")).alias("ordered_prevalence"), F.avg(F.col("concurrent").cast("double")).alias("concurrent_prevalence"),
        F.coalesce(conc / F.sqrt(n * F.nullif(n - ties, F.lit(0.0))), F.lit(0.0)).alias("kendall_tau"), F.avg(F.abs("gap")).alias("mean_abs_gap"),
        F.count(F.lit(1)).alias("n_pairs"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    adj = peaks.withColumn("_d", F.col("peak") - F.lag("peak").over(part.orderBy("peak")))
    m = adj.groupBy(*keys).agg(F.min("_d").alias("min_adjacent_gap"))
    return agg.join(m, keys) if keys else agg.withColumn("min_adjacent_gap", m.scalar())


def roll(act: DataFrame, shifts: DataFrame, n: int, keys: list[str] = ()) -> DataFrame:
    """Roll each archetype's profile by its shift (keys, rep, k, shift); index and t follow the grid."""
    keys = list(keys)
    grid = act.select("t_idx", "t").distinct()
    j = act.drop("t").join(shifts, [*keys, "k"]).withColumn("t_idx", F.pmod(F.col("t_idx") + F.col("shift"), F.lit(n)).cast("int")).drop("shift")
    return j.join(F.broadcast(grid), "t_idx")  # one row per grid point


def circular_shift_null(act: DataFrame, n: int, n_rep: int, seed: int = 0) -> DataFrame:
    shifts = replicates(act.select("k").distinct(), n_rep).withColumn("shift", F.floor(hashing.uniform("rep", "k", seed=seed) * n).cast("int"))
    return roll(act, shifts, n)


def peak_resample_null(act: DataFrame, n: int, n_rep: int, seed: int = 0) -> DataFrame:
    pk = peak_table(act).select("k", F.col("t_idx").alias("_pk"))
    target = F.floor(hashing.uniform("rep", "k", seed=seed) * n).cast("int")
    return roll(act, replicates(pk, n_rep).select("k", "rep", (target - F.col("_pk")).alias("shift")), n)


def empirical_p(null: DataFrame, observed: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Add-one empirical p on both sides, mean, sample std, 5/50/95 % quantiles and fold over the null mean.

    Quantiles come from counted positions (:mod:`ranking`), so no task holds all null values of a key.
    """
    keys = list(keys)
    j = null.select(*keys, F.col(value).alias("v")).join(observed.select(*keys, F.col(value).alias("obs")), keys)
    n = F.count(F.lit(1))
    ge, le = F.sum(F.when(F.col("v") >= F.col("obs"), 1).otherwise(0)), F.sum(F.when(F.col("v") <= F.col("obs"), 1).otherwise(0))
    q = ranking.quantiles(j, "v", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, keys)
    sums = j.groupBy(*keys, "obs").agg(
        ((1 + ge) / (1 + n)).alias("p_greater"), ((1 + le) / (1 + n)).alias("p_less"), F.avg("v").alias("null_mean"),
        F.stddev_samp("v").alias("null_sd"), n.alias("n_null"), (F.first("obs") / F.greatest(F.avg("v"), F.lit(1e-9))).alias("fold"))
    return sums.join(q, keys, "left").select(*keys, "obs", "p_greater", "p_less", "null_mean", "null_sd", "q05", "q50", "q95", "n_null", "fold")


def bootstrap_weights(rows: DataFrame, key: str, n_boot: int, seed: int = 0, include_observed: bool = False) -> DataFrame:
    """Rows once per replicate with a Poisson(1) weight ``w`` from the row key; replicate -1 is the data itself."""
    reps = F.sequence(F.lit(-1 if include_observed else 0), F.lit(n_boot - 1))
    out = rows.withColumn("rep", F.explode(reps))
    w = F.when(F.col("rep") < 0, F.lit(1)).otherwise(hashing.poisson_one(key, "rep", seed=seed)).cast("double")
    return out.withColumn("w", w).where(F.col("w") > 0)


def mean_pairwise_correlation(curves: DataFrame, keys: list[str], run: str, t: str, value: str) -> DataFrame:
    """Mean Pearson over all pairs of runs (few, by construction) per key: (keys, mean_r)."""
    a = curves.select(*keys, t, F.col(run).alias("r1"), F.col(value).alias("v1"))
    b = curves.select(*keys, t, F.col(run).alias("r2"), F.col(value).alias("v2"))
    c = a.join(b, [*keys, t]).where(F.col("r1") < F.col("r2")).groupBy(*keys, "r1", "r2").agg(F.corr("v1", "v2").alias("r"))
    return c.groupBy(*keys).agg(F.avg("r").alias("mean_r"))


def block_permutation(curve: DataFrame, n: int, block: int, n_rep: int, seed: int = 0, keys: list[str] = ()) -> DataFrame:
    """Shuffle contiguous blocks of the index, the incomplete tail stays: (keys, rep, t_idx, ...)."""
    full = n // block
    b = curve.sparkSession.range(full).select(F.col("id").cast("int").alias("b"))
    order = replicates(b, n_rep).withColumn("to", F.row_number().over(W.partitionBy("rep").orderBy(hashing.uniform("rep", "b", seed=seed), "b")) - 1)
    c = replicates(curve, n_rep).withColumn("b", F.floor(F.col("t_idx") / block).cast("int"))
    j = c.join(order, ["rep", "b"], "left")
    to = F.when(F.col("b") < full, F.col("to") * block + F.col("t_idx") % block).otherwise(F.col("t_idx"))
    return j.withColumn("t_idx", to.cast("int")).drop("b", "to")


def block_bootstrap_p(pairs: DataFrame, n: int, block: int, n_rep: int, seed: int = 0, keys: list[str] = ()) -> DataFrame:
    """Two-sided p of a correlation with circular blocks of x drawn with replacement; floor 1/(n_rep+1).

    ``pairs`` is (keys, t_idx 0..n-1, x, y). Draws are rows (rep, position) and the curve has n rows per key.
    """
    keys = list(keys)
    obs = pairs.groupBy(*keys).agg(F.corr("x", "y").alias("r"))
    pos = pairs.sparkSession.range(n_rep * n).select((F.col("id") / n).cast("int").alias("rep"), (F.col("id") % n).cast("int").alias("t_idx"))
    start = F.floor(hashing.uniform("rep", F.floor(F.col("t_idx") / block), seed=seed) * n)
    pos = pos.withColumn("src", F.pmod(start + F.col("t_idx") % block, F.lit(n)).cast("int"))
    x = pairs.select(*keys, F.col("t_idx").alias("src"), F.col("x").alias("xs"))
    d = pairs.select(*keys, "t_idx", "y").join(pos, "t_idx").join(x, [*keys, "src"])
    null = d.groupBy(*keys, "rep").agg(F.corr("xs", "y").alias("rn"))
    j = null.join(obs, keys) if keys else null.withColumn("r", obs.scalar())
    p = F.avg(F.when(F.abs("rn") >= F.abs("r"), 1.0).otherwise(0.0))
    return j.groupBy(*keys).agg(F.first("r").alias("r"), F.greatest(p, F.lit(1.0 / (n_rep + 1))).alias("p"))


def lag1(series: DataFrame, keys: list[str] = (), value: str = "v") -> DataFrame:
    """Lag-1 autocorrelation, each leg centred on its own mean: (keys, n, lag1)."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    s = series.withColumn("_n", F.lead(value).over(part.orderBy("t_idx")))
    r = F.corr(F.when(F.col("_n").isNotNull(), F.col(value)), "_n")
    return s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, r).alias("lag1"))


def acf(series: DataFrame, max_lag: int, keys: list[str] = (), value: str = "v") -> DataFrame:
    """Biased autocorrelation for lags 0..max_lag: (keys, lag, rho). Index values must be consecutive."""
    keys = list(keys)
    m = series.groupBy(*keys).agg(F.avg(value).alias("_m"))
    s = series.join(m, keys) if keys else series.withColumn("_m", m.scalar())
    s = s.select(*keys, "t_idx", (F.col(value) - F.col("_m")).alias("c"))
    var = s.groupBy(*keys).agg(F.sum(F.col("c") * F.col("c")).alias("_v"))
    ahead = s.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).select(*keys, "lag", (F.col("t_idx") - F.col("lag")).alias("t_idx"), F.col("c").alias("c2"))
    num = s.join(ahead, [*keys, "t_idx"]).groupBy(*keys, "lag").agg(F.sum(F.col("c") * F.col("c2")).alias("_s"))
    j = num.join(var, keys) if keys else num.withColumn("_v", var.scalar())
    return j.select(*keys, "lag", F.when(F.col("_v") > 0, F.col("_s") / F.col("_v")).otherwise(0.0).alias("rho"))


def neff_ar1(lag_x: Column, lag_y: Column, n: Column) -> Column:
    """n (1 - r1 r2) / (1 + r1 r2), the factor clamped to [1/n, 1]; n when a lag is undefined."""
    f = (1.0 - lag_x * lag_y) / (1.0 + lag_x * lag_y + F.lit(1e-12))
    return F.when(lag_x.isNull() | lag_y.isNull(), n.cast("double")).otherwise(n * F.greatest(F.least(f, F.lit(1.0)), 1.0 / n))


def neff_bartlett(acf_x: DataFrame, acf_y: DataFrame, n: int, keys: list[str] = ()) -> DataFrame:
    """n / (1 + 2 sum (1 - k/n) rho_x rho_y), cut at the first lag with both inside 2/sqrt(n): (keys, neff)."""
    keys = list(keys)
    band = 2.0 / n ** 0.5
    j = acf_x.withColumnRenamed("rho", "rx").join(acf_y.withColumnRenamed("rho", "ry"), [*keys, "lag"]).where(F.col("lag") >= 1)
    inside = (F.abs("rx") < band) & (F.abs("ry") < band)
    cut = j.groupBy(*keys).agg(F.coalesce(F.min(F.when(inside, F.col("lag"))), F.max("lag")).alias("cut"))
    j = j.join(cut, keys) if keys else j.withColumn("cut", cut.scalar())
    s = F.sum(F.when(F.col("lag") <= F.col("cut"), (1.0 - F.col("lag") / F.lit(float(n))) * F.col("rx") * F.col("ry")).otherwise(0.0))
    return j.groupBy(*keys).agg((F.lit(float(n)) / F.greatest(1.0 + 2.0 * s, F.lit(1.0 / n))).alias("neff"))


def corr_t(r: Column, n_eff: Column) -> tuple[Column, Column]:
    """(t statistic, two-sided p) with n_eff - 2 degrees of freedom; NULL when n_eff <= 2."""
    t = r * F.sqrt((n_eff - 2.0) / (1.0 - F.least(F.lit(0.999999), r * r)))
    ok = n_eff > 2.0
    return F.when(ok, t), F.when(ok, t_two_sided(t, n_eff - 2.0))


def corrected_correlations(curves: DataFrame, tracks: DataFrame, n: int, keys: list[str], n_rep: int | None = None, block: int = 5, seed: int = 0) -> DataFrame:
    """r with naive, AR(1)- and Bartlett-corrected p for every archetype (keys, k, t_idx, a) and track (keys, track, t_idx, v)."""
    keys = list(keys)
    on = [*keys, "k", "track"]
    p = curves.join(tracks, [*keys, "t_idx"])
    base = p.groupBy(*on).agg(F.corr("a", "v").alias("r"), F.count(F.lit(1)).alias("n"))
    lx = lag1(curves.withColumnRenamed("a", "v"), [*keys, "k"]).select(*keys, "k", F.col("lag1").alias("lx"))
    ly = lag1(tracks, [*keys, "track"]).select(*keys, "track", F.col("lag1").alias("ly"))
    names = base.select(*on)
    ax = acf(curves.withColumnRenamed("a", "v"), n // 4, [*keys, "k"]).join(names, [*keys, "k"])
    ay = acf(tracks, n // 4, [*keys, "track"]).join(names, [*keys, "track"])
    bart = neff_bartlett(ax, ay, n, on)
    out = base.join(lx, [*keys, "k"]).join(ly, [*keys, "track"]).join(bart.withColumnRenamed("neff", "neff_bartlett"), on)
    out = out.withColumn("neff_ar1", neff_ar1(F.col("lx"), F.col("ly"), F.col("n")))
    for name, e in (("naive", F.col("n").cast("double")), ("ar1", F.col("neff_ar1")), ("bartlett", F.col("neff_bartlett"))):
        out = out.withColumn(f"p_{name}", corr_t(F.col("r"), e)[1])
    if n_rep is not None:
        pairs = p.select(*on, "t_idx", F.col("a").alias("x"), F.col("v").alias("y"))
        out = out.join(block_bootstrap_p(pairs, n, block, n_rep, seed, on).select(*on, F.col("p").alias("p_block")), on)
    return out.drop("lx", "ly")


def subsample(rows: DataFrame, key: str, frac: float, runs: int, seed: int = 0) -> DataFrame:
    """Rows once per run they are kept in (hashed draw): adds ``run``."""
    return rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).where(hashing.uniform(key, "run", seed=seed) < frac)


def bootstrap_band(curves: DataFrame, lo: float = 0.1, hi: float = 0.9, keys: list[str] = ()) -> DataFrame:
    """Pointwise quantiles over replicate curves (rep, t_idx, v), from counted positions however many replicates there are."""
    return ranking.quantiles(curves, "v", {"lo": lo, "hi": hi}, [*keys, "t_idx"])
