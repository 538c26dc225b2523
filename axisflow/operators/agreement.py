"""Agreement between runs, methods, rankings and curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing, ranking
from ..functions.vectors import dot, norm
from ..session import cut_lineage


def pattern_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine between flattened patterns (k, p array) of two sets: (ka, kb, cosine). Sets hold a handful of patterns."""
    x = a.select(F.col("k").alias("ka"), F.posexplode("p").alias("e", "x"))
    y = b.select(F.col("k").alias("kb"), F.posexplode("p").alias("e", "y"))
    d = x.join(y, "e").groupBy("ka", "kb").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    na = a.select(F.col("k").alias("ka"), norm("p").alias("na"))
    nb = b.select(F.col("k").alias("kb"), norm("p").alias("nb"))
    eps = F.lit(1e-8)
    return d.join(na, "ka").join(nb, "kb").select("ka", "kb", (F.col("d") / ((F.col("na") + eps) * (F.col("nb") + eps))).alias("cosine"))


def greedy_match(similarity: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Match archetypes in index order to the best partner not yet used: (keys, ka, kb, cosine).

    One small similarity matrix (K x K) per key is handled per group.
    """
    keys = list(keys)
    t = dict(similarity.dtypes)
    schema = ", ".join(f"{k} {t[k]}" for k in keys) + (", " if keys else "") + f"ka {t['ka']}, kb {t['kb']}, cosine double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="ka", columns="kb", values="cosine").sort_index().sort_index(axis=1)
        used, rows = set(), []
        for ka in m.index[:min(m.shape)]:
            left = m.loc[ka].drop(list(used))
            kb = left.idxmax()
            used.add(kb)
            rows.append((ka, kb, float(m.loc[ka, kb])))
        out = pd.DataFrame(rows, columns=["ka", "kb", "cosine"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "ka", "kb", "cosine"]]
    src = similarity if keys else similarity.withColumn("_g", F.lit(0))
    grouped = src.groupBy(*(keys or ["_g"]))
    return grouped.applyInPandas(lambda p: run(p.drop(columns="_g", errors="ignore")), schema)


def match_summary(matched: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Median and worst matched cosine (K values per key)."""
    return matched.groupBy(*keys).agg(F.percentile("cosine", 0.5).alias("median_cosine"), F.min("cosine").alias("min_cosine"))


def _assignment_total(value: np.ndarray) -> float:
    """Greatest sum of one entry per row and column: shortest augmenting paths with row and column prices."""
    cost = -value
    k = len(cost)
    row_price, col_price = np.zeros(k), np.zeros(k + 1)
    owner = np.full(k + 1, -1)  # row that holds a column; the last column is the start of a path
    for row in range(k):
        owner[k] = row
        column, least, back, done = k, np.full(k, np.inf), np.full(k, k), np.zeros(k + 1, bool)
        while owner[column] >= 0:
            done[column] = True
            slack = cost[owner[column]] - row_price[owner[column]] - col_price[:k]
            closer = ~done[:k] & (slack < least)
            least[closer], back[closer] = slack[closer], column
            free = np.where(done[:k], np.inf, least)
            nearest = int(free.argmin())
            step = free[nearest]
            held = np.flatnonzero(done)
            row_price[owner[held]] += step
            col_price[held] -= step
            least[~done[:k]] -= step
            column = nearest
        while column != k:
            owner[column] = owner[back[column]]
            column = back[column]
    return float(sum(value[owner[c], c] for c in range(k)))


def best_match(corr: DataFrame, k: int, keys: list[str] = ()) -> DataFrame:
    """Largest mean over all one-to-one assignments of a K x K matrix (ka, kb in 0..k-1, c): (keys, mean_matched).

    One matrix of K x K numbers per key is solved in a task; a missing or null entry makes the result null.
    """
    keys = list(keys)
    types = dict(corr.dtypes)
    cells = corr.groupBy(*keys, "ka", "kb").agg(F.max("c").alias("c"))
    src = cells if keys else cells.withColumn("_g", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.full((k, k), np.nan)
        m[pdf["ka"].to_numpy(), pdf["kb"].to_numpy()] = pdf["c"].to_numpy(float)
        best = None if np.isnan(m).any() else _assignment_total(m) / k
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in keys), best]], columns=[*keys, "mean_matched"])
    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "mean_matched double"])
    return src.groupBy(*(keys or ["_g"])).applyInPandas(run, schema)


def peak_overlap(peaks: DataFrame, window: float = 0.1, keys: list[str] = ()) -> DataFrame:
    """Population std of the peak position over runs and the share of run pairs within the window: (run, peak) rows.

    Runs with the same peak are counted once; a RANGE frame over the sorted peaks counts what lies within the window. The
    axis is cut into buckets a window wide that also see their neighbours, so no task holds all runs of a key. Runs
    without a peak are left out.
    """
    keys = list(keys)
    width = F.lit(float(window) if window > 0 else 1.0)
    known = peaks.where(F.col("peak").isNotNull())
    s = known.groupBy(*keys).agg(F.stddev_pop("peak").alias("peak_std"), F.count(F.lit(1)).alias("n_runs"))
    counted = known.groupBy(*keys, F.col("peak").cast("double").alias("_at")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_home", F.floor(F.col("_at") / width))
    halo = counted.withColumn("_b", F.explode(F.array(F.col("_home") - 1, F.col("_home"), F.col("_home") + 1)))
    by = ", ".join(f"`{c}`" for c in [*keys, "_b"])
    near = halo.withColumn("_near", F.expr(f"sum(_c) OVER (PARTITION BY {by} ORDER BY _at RANGE BETWEEN {float(window)!r}D PRECEDING AND {float(window)!r}D FOLLOWING)"))
    near = near.where(F.col("_b") == F.col("_home"))
    close = near.groupBy(*keys).agg(F.sum(F.col("_c") * F.col("_near")).alias("_close"))
    both = s.join(close, keys) if keys else s.withColumn("_close", close.scalar())
    n = F.col("n_runs")
    frac = (F.coalesce("_close", n) - n) / 2 / F.greatest(n * (n - 1) / 2, F.lit(1.0))
    return both.select(*keys, "n_runs", "peak_std", frac.alias("overlap_frac"))


def sensitivity_report(patterns: DataFrame, curves: DataFrame, auroc: DataFrame, reference: str) -> DataFrame:
    """Metric rows (metric, config, value): cosine to the reference configuration, peak positions, spread and AUROC range."""
    ref = patterns.where(F.col("config") == reference).select("k", "p")
    x = ref.select(F.col("k").alias("ka"), F.posexplode("p").alias("e", "x"), norm("p").alias("na"))
    y = patterns.where(F.col("config") != reference).select("config", F.col("k").alias("kb"), F.posexplode("p").alias("e", "y"), norm("p").alias("nb"))
    sim = x.join(y, "e").groupBy("config", "ka", "kb", "na", "nb").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    sim = sim.select("config", "ka", "kb", (F.col("d") / ((F.col("na") + 1e-8) * (F.col("nb") + 1e-8))).alias("cosine"))
    m = match_summary(greedy_match(sim, ["config"]), ["config"])
    rows = m.select("config", F.explode(F.create_map(F.lit("median_cosine"), F.col("median_cosine"), F.lit("min_cosine"), F.col("min_cosine"))).alias("metric", "value"))
    pk = curves.groupBy("config").agg(F.max_by("t", F.struct("v", -F.col("t_idx"))).alias("peak"))
    rows = rows.unionByName(pk.select("config", F.lit("peak").alias("metric"), F.col("peak").alias("value")))
    ov = peak_overlap(pk)
    every = F.lit("all")
    rows = rows.unionByName(ov.select(every.alias("config"), F.lit("peak_std").alias("metric"), F.col("peak_std").alias("value")))
    rows = rows.unionByName(ov.select(every.alias("config"), F.lit("overlap_frac").alias("metric"), F.col("overlap_frac").alias("value")))
    rng = auroc.agg((F.max("auroc") - F.min("auroc")).alias("value")).select(every.alias("config"), F.lit("auroc_range").alias("metric"), "value")
    return rows.unionByName(rng)


def ranking_overlap(rankings: DataFrame, ks: list[int], keys: list[str] = ()) -> DataFrame:
    """Jaccard of the top-k lists for every method pair and k; empty against empty is 0.

    ``rankings`` is (keys, method, rank from 1, feature); only the top max(k) rows take part.
    """
    keys = list(keys)
    k_arr = F.array(*[F.lit(k) for k in ks])
    top = rankings.where(F.col("rank") <= max(ks)).select(*keys, "method", "feature", F.explode(k_arr).alias("k"), "rank").where(F.col("rank") <= F.col("k"))
    size = top.groupBy(*keys, "method", "k").agg(F.count_distinct("feature").alias("n"))
    names = rankings.select(*keys, "method").distinct().withColumn("k", F.explode(k_arr)).join(size, [*keys, "method", "k"], "left").na.fill(0, ["n"])
    pair = (names.withColumnsRenamed({"method": "m1", "n": "n1"}).join(names.withColumnsRenamed({"method": "m2", "n": "n2"}), [*keys, "k"])
            .where(F.col("m1") < F.col("m2")))
    hit = (top.select(*keys, "k", "feature", F.col("method").alias("m1")).join(top.select(*keys, "k", "feature", F.col("method").alias("m2")), [*keys, "k", "feature"])
           .where(F.col("m1") < F.col("m2")).groupBy(*keys, "k", "m1", "m2").agg(F.count(F.lit(1)).alias("both")))
    j = pair.join(hit, [*keys, "k", "m1", "m2"], "left").na.fill(0, ["both"])
    union = F.col("n1") + F.col("n2") - F.col("both")
    return j.select(*keys, "k", "m1", "m2", F.when(union > 0, F.col("both") / union).otherwise(0.0).alias("jaccard"))


def mean_overlap(overlap: DataFrame) -> DataFrame:
    return overlap.groupBy("k").agg(F.avg("jaccard").alias("mean_jaccard"))


def spearman_pairs(long: DataFrame, item: str, method: str = "method", value: str = "score", keys: list[str] = (), min_n: int = 0) -> DataFrame:
    """Spearman correlation of every method pair over their common items: (keys, m1, m2, n, rho)."""
    keys = list(keys)
    a = long.select(*keys, item, F.col(method).alias("m1"), F.col(value).alias("v1")).where(F.col("v1").isNotNull())
    b = long.select(*keys, item, F.col(method).alias("m2"), F.col(value).alias("v2")).where(F.col("v2").isNotNull())
    on = [*keys, "m1", "m2"]
    j = cut_lineage(a.join(b, [*keys, item]).where(F.col("m1") < F.col("m2")).select(*on, "v1", "v2"))
    r = ranking.average_ranks(j, {"v1": "r1", "v2": "r2"}, on)
    s = r.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.corr("r1", "r2").alias("rho"))
    return s.where(F.col("n") >= min_n) if min_n else s


def spearman_two(df: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """Spearman correlation of two columns per key: (keys, n, rho)."""
    both = cut_lineage(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b))
    r = ranking.average_ranks(both, {a: "_r1", b: "_r2"}, list(keys))
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_r1", "_r2").alias("rho"))


def set_compare(a: DataFrame, b: DataFrame, col: str = "feature") -> DataFrame:
    """Members of either set with where they occur: a_only, b_only or shared."""
    x, y = a.select(col).distinct().withColumn("_a", F.lit(1)), b.select(col).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, col, "full")
    where = F.when(F.col("_a").isNull(), "b_only").when(F.col("_b").isNull(), "a_only").otherwise("shared")
    return j.select(col, where.alias("where"))


def branch_sets(members: DataFrame, col: str = "feature") -> DataFrame:
    """Members exclusive to one branch and members shared by all: (feature, n_branches, kind, branch)."""
    nb = members.agg(F.count_distinct("branch").alias("n")).scalar()
    g = members.groupBy(col).agg(F.count_distinct("branch").alias("n_branches"), F.min("branch").alias("branch"))
    kind = F.when(F.col("n_branches") == 1, "exclusive").when(F.col("n_branches") == nb, "shared_by_all").otherwise("some")
    return g.withColumn("kind", kind).withColumn("branch", F.when(F.col("kind") == "exclusive", F.col("branch")))


def ordering_agreement(long: DataFrame, threshold: float = 0.81, min_rows: int = 20, min_pairs: int = 10) -> DataFrame:
    """Mean and smallest pairwise Spearman of orderings within each branch; rows (branch, cell_id, method, score)."""
    size = long.groupBy("branch").agg(F.count_distinct("cell_id").alias("n_rows")).where(F.col("n_rows") >= min_rows)
    rho = spearman_pairs(long.join(size.select("branch"), "branch", "left_semi"), "cell_id", keys=["branch"], min_n=min_pairs)
    s = rho.groupBy("branch").agg(F.avg("rho").alias("mean_rho"), F.min("rho").alias("min_rho"))
    return size.join(s, "branch", "left").withColumn("above_threshold", F.coalesce(F.col("min_rho") >= threshold, F.lit(False)))


def concordance_scores(a: DataFrame, b: DataFrame, by: str = "cluster") -> DataFrame:
    """Spearman over clusters of two methods' scores and whether their top cluster agrees (one row)."""
    j = a.select(by, F.col("score").alias("sa")).join(b.select(by, F.col("score").alias("sb")), by)
    rho = spearman_two(j, "sa", "sb").select(F.struct("n", "rho")).scalar()
    top = j.agg(F.min_by(by, F.struct(-F.col("sa"), by)).alias("top_a"), F.min_by(by, F.struct(-F.col("sb"), by)).alias("top_b"))
    return top.select(rho["n"].alias("n_clusters"), rho["rho"].alias("rho"), "top_a", "top_b", (F.col("top_a") == F.col("top_b")).alias("argmax_match"))


def concordance_vectors(a: DataFrame, b: DataFrame, by: str = "cluster") -> DataFrame:
    """|cosine| of two feature vectors per cluster; long rows (cluster, feature, w)."""
    na = a.groupBy(by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("na"))
    nb = b.groupBy(by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nb"))
    d = a.join(b.withColumnRenamed("w", "w2"), [by, "feature"]).groupBy(by).agg(F.sum(F.col("w") * F.col("w2")).alias("d"))
    eps = F.lit(1e-12)
    return d.join(na, by).join(nb, by).select(by, F.abs(F.col("d") / ((F.col("na") + eps) * (F.col("nb") + eps))).alias("abs_cosine"))


def random_cosine_null(spark, dim: int, n: int, seed: int = 0, q: float = 0.95) -> DataFrame:
    """Quantile of |cosine| between hashed normal vector pairs of the given width."""
    e = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("i"))
    e = e.withColumns({"x": hashing.normal("id", "i", seed=seed), "y": hashing.normal("id", "i", seed=seed + 1)})
    c = e.groupBy("id").agg((F.abs(F.sum(F.col("x") * F.col("y"))) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("c"))
    return ranking.quantiles(c, "c", {"null_q": q})


def concordance_lists(a: DataFrame, b: DataFrame, top_k: int, n_features: int, by: str = "cluster") -> DataFrame:
    """Jaccard of top-k lists per cluster, chance level K/(2V-K), fold over chance and rank Spearman."""
    both = a.withColumn("method", F.lit("a")).unionByName(b.withColumn("method", F.lit("b")))
    ranked = ranking.top_n(both, top_k, [F.col("score").desc(), F.col("feature")], [by, "method"])
    jac = ranking_overlap(ranked, [top_k], [by]).select(by, "jaccard")
    rho = spearman_pairs(both, "feature", keys=[by]).select(by, "rho")
    chance = top_k / (2 * n_features - top_k) if n_features > top_k else 1.0
    return jac.join(rho, by).withColumn("chance", F.lit(chance)).withColumn("fold", F.col("jaccard") / F.lit(max(chance, 1e-9)))


def window_projection_agreement(rows: DataFrame, directions: DataFrame, half: float, min_rows: int = 10) -> DataFrame:
    """Per window, |Spearman| of two projections of the same rows.

    ``rows`` (cell_id, t, xa, xb), ``directions`` (t_idx, t, va, vb) one row per window (a bounded grid).
    """
    packed = directions.agg(F.sort_array(F.collect_list(F.struct("t_idx", F.col("t").alias("c"), "va", "vb"))).alias("g")).scalar()
    e = rows.withColumn("_g", F.explode(packed)).where(F.abs(F.col("t") - F.col("_g.c")) <= half)
    e = e.select("cell_id", F.col("_g.t_idx").alias("t_idx"), dot("xa", "_g.va").alias("sa"), dot("xb", "_g.vb").alias("sb"))
    s = spearman_two(e, "sa", "sb", ["t_idx"])
    return s.where(F.col("n") >= min_rows).select("t_idx", "n", F.abs("rho").alias("abs_rho"))


def curve_recovery(rec: DataFrame, truth: DataFrame, grid: list[float], keys: list[str] = (), threshold: float = 0.0) -> DataFrame:
    """Pearson, sign agreement, RMSE, peak error and spurious-peak flag of a curve (t, v) against the truth."""
    from .windows import resample_to_grid
    keys = list(keys)
    a = resample_to_grid(rec, grid, "v", keys).withColumnRenamed("value", "r")
    b = resample_to_grid(truth, grid, "v", keys).select(*keys, "t_idx", F.col("value").alias("g"))
    j = a.join(b, [*keys, "t_idx"])
    flat = F.stddev_pop("g") == 0
    order = lambda c: F.struct(F.col(c), -F.col("t_idx"))
    return j.groupBy(*keys).agg(
        F.corr("r", "g").alias("pearson"), F.avg(F.when(F.signum("r") == F.signum("g"), 1.0).otherwise(0.0)).alias("sign_agreement"),
        F.sqrt(F.avg(F.pow(F.col("r") - F.col("g"), 2))).alias("rmse"), F.abs(F.max_by("t", order("r")) - F.max_by("t", order("g"))).alias("peak_error"),
        (flat & (F.max("g") <= 0) & (F.max("r") >= threshold)).alias("spurious_peak"))


def marker_enrichment(ranked: DataFrame, markers: DataFrame, branches: DataFrame, top: int = 30) -> DataFrame:
    """Share of a branch's markers among its top features (upper-cased): (branch, marker)."""
    t = ranked.where(F.col("rank") <= top).select("branch", F.upper("feature").alias("feature")).distinct()
    m = markers.select("branch", F.upper("feature").alias("feature")).distinct()
    hit = m.join(t, ["branch", "feature"], "left_semi").groupBy("branch").agg(F.count(F.lit(1)).alias("h"))
    size = m.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))
    return branches.join(hit, "branch", "left").join(size, "branch", "left").select("branch", F.coalesce(F.col("h") / F.col("n"), F.lit(0.0)).alias("marker"))


def benchmark_score(ranked: DataFrame, markers: DataFrame, peaks: DataFrame, fits: DataFrame, top_markers: int = 30, top_specific: int = 20) -> DataFrame:
    """Composite of marker enrichment, specificity, stability, timing spread and R2 (one row).

    ``ranked`` (branch, rank, feature), ``markers`` (branch, feature), ``peaks`` (branch, seed, peak), ``fits`` (branch, r2).
    """
    branches = ranked.select("branch").distinct()
    marker = marker_enrichment(ranked, markers, branches, top_markers).agg(F.avg("marker").alias("m")).scalar()
    lists = ranked.select(F.col("branch").alias("method"), "rank", F.upper("feature").alias("feature"))
    spec = ranking_overlap(lists, [top_specific]).agg(F.coalesce(1.0 - F.avg("jaccard"), F.lit(1.0)).alias("s")).scalar()
    sd = peaks.groupBy("branch").agg(F.stddev_pop("peak").alias("sd"), F.count("peak").alias("n")).where(F.col("n") > 1)
    stab = sd.agg((1.0 / (1.0 + F.coalesce(F.avg("sd"), F.lit(0.0)))).alias("s")).scalar()
    first = peaks.groupBy("branch").agg(F.min_by("peak", "seed").alias("peak"))
    timing = first.agg(F.coalesce(F.least(F.stddev_pop("peak") / 0.5, F.lit(1.0)), F.lit(0.0)).alias("t")).scalar()
    r2 = fits.agg(F.avg("r2").alias("r")).scalar()
    one = ranked.sparkSession.range(1).select(marker.alias("marker"), spec.alias("specificity"), stab.alias("stability"), timing.alias("timing"), r2.alias("r2"))
    total = 0.30 * F.col("marker") + 0.20 * F.col("specificity") + 0.20 * F.col("stability") + 0.15 * F.col("timing") + 0.15 * F.col("r2")
    return one.withColumn("composite", total)


def safe_pivot(df: DataFrame, rows: str, cols: str, values: list, value: str) -> DataFrame:
    """Mean by two keys with the columns in the given order, NULL where empty."""
    return df.groupBy(rows).pivot(cols, values).agg(F.avg(value))


def evaluate_thresholds(metrics: DataFrame, pvalues: DataFrame, rules: dict[str, dict], alpha: float = 0.01) -> DataFrame:
    """Pass or fail by system. ``rules`` maps an expected signal to {'need': {metric: floor}, 'forbid': [metrics]}.

    ``metrics`` (system, signal, metric, value), ``pvalues`` (system, metric, p): needed metrics must reach their
    floor with every p below alpha; forbidden metrics must have no p below alpha.
    """
    m = metrics.join(pvalues.groupBy("system", "metric").agg(F.max("p").alias("p_max"), F.min("p").alias("p_min")), ["system", "metric"], "left")
    ok = F.lit(True)
    for signal, rule in rules.items():
        for name, floor in rule.get("need", {}).items():
            bad = (F.col("signal") == signal) & (F.col("metric") == name) & ~((F.col("value") >= floor) & (F.col("p_max") < alpha))
            ok = ok & ~F.coalesce(bad, F.lit(True))
        for name in rule.get("forbid", []):
            bad = (F.col("signal") == signal) & (F.col("metric") == name) & (F.col("p_min") < alpha)
            ok = ok & ~F.coalesce(bad, F.lit(False))
    return m.groupBy("system", "signal").agg(F.bool_and(ok).alias("passed"))


def best_run(runs: DataFrame) -> DataFrame:
    """Run of highest mean R2 per method from (method, run, branch, r2)."""
    m = runs.groupBy("method", "run").agg(F.avg("r2").alias("mean_r2"))
    return m.groupBy("method").agg(F.min(F.struct(-F.col("mean_r2"), "run")).alias("b")).select("method", F.col("b.run").alias("run"), (-F.col("b.col1")).alias("mean_r2"))


def benjamini_hochberg(df: DataFrame, keys: list[str] = (), p: str = "p", tie: str = "id") -> DataFrame:
    """Adjusted p: running minimum from the largest rank of p * m / rank.

    The running minimum is taken over position segments whose own minima are combined first, so a family of
    any size is spread over tasks.
    """
    keys = list(keys)
    pos = ranking.row_positions(df, p, tie, keys, "_pos")
    if keys:
        pos = pos.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    else:
        pos = pos.withColumn("_m", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    pos = pos.withColumn("_a", F.col(p) * F.col("_m") / (F.col("_pos") + 1)).withColumn("_s", F.floor(F.col("_pos") / 100_000))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    later = pos.groupBy(*keys, "_s").agg(F.min("_a").alias("_sm"))
    later = later.withColumn("_after", F.min("_sm").over(part.orderBy(F.col("_s").desc()).rowsBetween(W.unboundedPreceding, -1))).drop("_sm")
    inside = W.partitionBy(*keys, "_s").orderBy(F.col("_pos").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = pos.withColumn("_in", F.min("_a").over(inside)).join(later, [*keys, "_s"])
    return out.withColumn("fdr", F.least(F.col("_in"), F.coalesce("_after", F.lit(1.0)), F.lit(1.0))).drop("_pos", "_m", "_a", "_s", "_in", "_after")


def set_enrichment_slices(table: DataFrame, order: list[str], name: str = "set_name") -> DataFrame:
    """-log10 of the FDR floored at 1e-40, for the sets in the given order (missing sets stay as NULL rows)."""
    wanted = F.explode(F.arrays_zip(F.array(*[F.lit(o) for o in order]).alias("n"), F.array(*[F.lit(i) for i in range(len(order))]).alias("i")))
    frame = table.sparkSession.range(1).select(wanted.alias("z")).select(F.col("z.n").alias(name), F.col("z.i").alias("slot"))
    return frame.join(table.withColumn("neglog10_fdr", -F.log10(F.greatest("fdr", F.lit(1e-40)))), name, "left")
