"""Normalisation, feature selection, residuals, projections.

``expr`` tables are sparse triplets (cell_id, feature, value); an absent row is a zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, ranking
from ..functions.gram import second_moments
from ..functions.scalars import stat
from ..functions.vectors import dot, literal, sq_dist

# Fixed values
RAW_COUNT_MAX = 50.0
LIBRARY_TARGET = 1e4


def needs_normalising(expr: DataFrame, threshold: float = RAW_COUNT_MAX) -> DataFrame:
    """One row: the largest value and whether it looks like raw counts."""
    m = F.max("value")
    return expr.agg(m.alias("max_value"), (m > threshold).alias("needs_normalising"))


def normalize_total(expr: DataFrame, target: float = LIBRARY_TARGET, log1p: bool = True) -> DataFrame:
    """Scale each cell to ``target`` total, then log(1+x). Totals are aggregated map-side and joined."""
    totals = expr.groupBy("cell_id").agg(F.sum("value").alias("_tot"))
    v = F.coalesce(F.try_divide(F.col("value") * F.lit(target), F.col("_tot")), F.lit(0.0))
    return expr.join(totals, "cell_id").select("cell_id", "feature", (F.log1p(v) if log1p else v).alias("value"))


def filter_features(expr: DataFrame, min_cells: int) -> DataFrame:
    """Keep features that are non-zero in at least ``min_cells`` cells (one row per cell and feature)."""
    seen = expr.where(F.col("value") != 0).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return expr.join(seen.where(F.col("n") >= min_cells), "feature", "left_semi")


def feature_moments(expr: DataFrame, n_cells: Column | int) -> DataFrame:
    """Mean and population variance per feature, implicit zeros included."""
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    s = expr.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.col("s") / n
    return s.select("feature", mean.alias("mean"), (F.col("ss") / n - mean * mean).alias("var"))


def highly_variable(expr: DataFrame, n_top: int, n_cells: Column | int, n_bins: int = 20) -> DataFrame:
    """Dispersion ranking inside equal-width mean bins; rows (feature, mean, dispersion, score, rank).

    ``expr`` holds log(1 + x); moments are those of x. Bins are closed on the right. A bin with one member scores it 1.
    Scores that agree in nine digits are ranked by feature.
    """
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    m = feature_moments(expr.withColumn("value", F.expm1("value")), n)
    m = m.where(F.col("mean") > 0).select(
        "feature", F.log1p("mean").alias("mean"),
        F.log((F.col("var") * n / (n - 1) + F.lit(1e-12)) / F.col("mean")).alias("dispersion"))
    s = stat(m, lo=F.min("mean"), hi=F.max("mean"))
    width = (s["hi"] - s["lo"] + F.lit(1e-12)) / F.lit(float(n_bins))
    m = m.withColumn("bin", F.least(F.greatest(F.ceil((F.col("mean") - s["lo"]) / width) - 1, F.lit(0)), F.lit(n_bins - 1)))
    # at most ``n_bins`` rows, so the join side is small by construction
    per_bin = m.groupBy("bin").agg(F.avg("dispersion").alias("bm"), F.stddev_samp("dispersion").alias("bs"), F.count(F.lit(1)).alias("bn"))
    z = F.when(F.col("bn") == 1, F.lit(1.0)).when(F.col("bs") > 0, (F.col("dispersion") - F.col("bm")) / F.col("bs")).otherwise(F.lit(0.0))
    scored = m.join(F.broadcast(per_bin), "bin").select("feature", "mean", "dispersion", z.alias("score"))
    return ranking.top_n(scored, n_top, [F.round("score", 9).desc(), F.col("feature")])


def tfidf(expr: DataFrame, n_cells: Column | int, scale: float = 1e4) -> DataFrame:
    """log(1 + tf * idf * scale) with tf = value / row total, idf = log(1 + N / (1 + df))."""
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    totals = expr.groupBy("cell_id").agg(F.sum("value").alias("_tot"))
    df_ = expr.where(F.col("value") > 0).groupBy("feature").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log(F.lit(1.0) + n / (F.lit(1.0) + F.col("_df")))
    return (expr.join(totals, "cell_id").join(df_, "feature")
            .select("cell_id", "feature", F.log1p(F.coalesce(F.try_divide(F.col("value"), F.col("_tot")), F.lit(0.0)) * idf * F.lit(scale)).alias("value")))


def top_variable(expr: DataFrame, n: int, n_cells: Column | int) -> DataFrame:
    """The ``n`` features of largest population variance (zeros count), with rank."""
    m = feature_moments(expr, n_cells).select("feature", "var")
    return ranking.top_n(m, n, [F.col("var").desc(), F.col("feature")])


def row_depth(expr: DataFrame) -> DataFrame:
    """Median and quartiles of the row totals."""
    depth = expr.groupBy("cell_id").agg(F.sum("value").alias("depth"))
    return ranking.quantiles(depth, "depth", {"q25": 0.25, "median": 0.5, "q75": 0.75})


def gene_set_score(expr: DataFrame, sets: DataFrame, n_bins: int = 25, ctrl_size: int = 50, seed: int = 0) -> DataFrame:
    """Per cell and set: mean over the set minus mean over expression-matched control features.

    ``sets`` is (set_name, feature). For every mean-expression bin touched by a set, the control is the
    ``ctrl_size`` bin members with the smallest hash that are not in the set. Every cell of ``expr`` has a row per set,
    also without a value of its features.
    """
    means = expr.groupBy("feature").agg(F.sum("value").alias("m"))
    pre = ranking.prefix_counts(means, [], "m")
    bin_ = F.least(F.floor(F.col("before") * n_bins / F.col("total")), F.lit(n_bins - 1))
    binned = means.join(pre, "m").select("feature", bin_.alias("bin"))
    inside = sets.join(binned, "feature")
    touched = inside.select("set_name", "bin").distinct()
    pool = binned.join(touched, "bin").join(sets, ["set_name", "feature"], "left_anti")
    pool = ranking.top_n(pool, ctrl_size, [hashing.uniform("feature", seed=seed), F.col("feature")], ["set_name", "bin"], "_r")
    members = (inside.select("set_name", "feature", F.lit("set").alias("role"))
               .union(pool.select("set_name", "feature", F.lit("ctrl").alias("role"))))
    sizes = members.groupBy("set_name").agg(F.sum(F.when(F.col("role") == "set", 1).otherwise(0)).alias("ns"),
                                            F.sum(F.when(F.col("role") == "ctrl", 1).otherwise(0)).alias("nc"))
    # features recur in several sets: set lists are small, so this join grows with expr only
    part = expr.join(members, "feature").groupBy("cell_id", "set_name").agg(
        F.sum(F.when(F.col("role") == "set", F.col("value")).otherwise(0.0)).alias("vs"),
        F.sum(F.when(F.col("role") == "ctrl", F.col("value")).otherwise(0.0)).alias("vc"))
    score = F.col("vs") / F.col("ns") - F.coalesce(F.col("vc") / F.nullif(F.col("nc"), F.lit(0)), F.lit(0.0))
    names = sizes.where(F.col("ns") > 0).agg(F.array_sort(F.collect_set("set_name"))).scalar()
    cells = expr.select("cell_id").distinct().withColumn("set_name", F.explode(names))
    full = cells.join(part, ["cell_id", "set_name"], "left").na.fill(0.0, ["vs", "vc"])
    return full.join(sizes, "set_name").select("cell_id", "set_name", score.alias("score"))


def phase_label(scores: DataFrame, first: str = "S", second: str = "G2M", neither: str = "G1") -> DataFrame:
    """The larger of two set scores names the row; both negative gives ``neither``."""
    wide = scores.groupBy("cell_id").agg(
        F.coalesce(F.max(F.when(F.col("set_name") == first, F.col("score"))), F.lit(0.0)).alias("a"),
        F.coalesce(F.max(F.when(F.col("set_name") == second, F.col("score"))), F.lit(0.0)).alias("b"))
    label = (F.when((F.col("a") < 0) & (F.col("b") < 0), neither)
             .when(F.col("b") > F.col("a"), second).otherwise(first))
    return wide.select("cell_id", F.col("a").alias(f"{first}_score"), F.col("b").alias(f"{second}_score"), label.alias("phase"))


def _gram(df: DataFrame, left: list[Column], right: list[Column]) -> np.ndarray:
    """Sum of products of two lists of row expressions as one aggregate (|left| x |right| numbers)."""
    aggs = [F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right)]
    return np.array(df.agg(*aggs).first(), dtype=float).reshape(len(left), len(right))


def residualise(df: DataFrame, columns: list[str], covariates: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """Ordinary least squares of each column on the covariates (with intercept): residual columns and
    the share of variance removed. The cross products are one distributed aggregate; only the small
    normal equations are solved on the driver."""
    z = [F.lit(1.0)] + [F.col(c) for c in covariates]
    x = [F.col(c) for c in columns]
    beta = np.linalg.lstsq(_gram(df, z, z), _gram(df, z, x), rcond=None)[0]
    resid = {}
    for j, c in enumerate(columns):
        fit = F.lit(float(beta[0, j]))
        for i, cov in enumerate(covariates):
            fit = fit + F.lit(float(beta[i + 1, j])) * F.col(cov)
        resid[f"{c}_resid"] = F.col(c) - fit
    out = df.withColumns(resid)
    v = out.agg(*[F.var_pop(c) for c in columns], *[F.var_pop(f"{c}_resid") for c in columns]).first()
    k = len(columns)
    return out, {c: 1.0 - v[k + j] / v[j] if v[j] else 0.0 for j, c in enumerate(columns)}


def residualise_one(df: DataFrame, column: str, covariate: str) -> DataFrame:
    """One covariate: slope and intercept as scalar aggregates; adds ``{column}_resid``."""
    s = stat(df, b=F.regr_slope(column, covariate), a=F.regr_intercept(column, covariate))
    return df.withColumn(f"{column}_resid", F.col(column) - (s["a"] + s["b"] * F.col(covariate)))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-score with the population standard deviation; constant columns become 0."""
    s = stat(df, **{f"m_{c}": F.avg(c) for c in columns}, **{f"s_{c}": F.stddev_pop(c) for c in columns})
    return df.withColumns({c: F.when(s[f"s_{c}"] > 0, (F.col(c) - s[f"m_{c}"]) / s[f"s_{c}"]).otherwise(F.lit(0.0))
                           for c in columns})


def balance_blocks(a: DataFrame, b: DataFrame, dim_a: int, dim_b: int, key: str = "cell_id") -> DataFrame:
    """Scale each block by 1/sqrt(width) and concatenate: (key, x)."""
    sa, sb = F.lit(dim_a ** -0.5), F.lit(dim_b ** -0.5)
    return (a.select(key, F.transform("x", lambda v: v * sa).alias("_a"))
            .join(b.select(key, F.transform("x", lambda v: v * sb).alias("_b")), key)
            .select(key, F.concat("_a", "_b").alias("x")))


def fit_pca(latent: DataFrame, dim: int, n: int) -> dict:
    """Principal axes from the second-moment aggregate: {'mean': (D,), 'components': (n, D), 'variance': (n,)}.

    One pass over the rows; the D x D eigenproblem is the only driver step.
    """
    n_rows, total, xx = second_moments(latent, "x", dim)
    mean = total / n_rows
    cov = xx / n_rows - np.outer(mean, mean)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:n]
    comp = vecs[:, order].T
    comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(axis=1)])[:, None]
    return {"mean": mean, "components": comp, "variance": vals[order], "ratio": vals[order] / max(vals.sum(), 1e-300)}


def pca_encode(latent: DataFrame, model: dict, out: str = "z") -> DataFrame:
    """z = (x - mean) W^T."""
    centred = F.zip_with("x", literal(model["mean"]), lambda a, b: a - b)
    return latent.withColumn(out, F.array(*[dot(centred, literal(w)) for w in model["components"]]))


def pca_decode(latent: DataFrame, model: dict, code: str = "z", out: str = "x_hat") -> DataFrame:
    """x_hat = z W + mean."""
    cols = model["components"].T
    return latent.withColumn(out, F.array(*[dot(F.col(code), literal(w)) + F.lit(float(m))
                                            for w, m in zip(cols, model["mean"])]))


def reconstruction_error(latent: DataFrame, a: str = "x", b: str = "x_hat") -> DataFrame:
    """Mean squared error over all rows and components."""
    return latent.agg((F.sum(sq_dist(a, b)) / F.sum(F.size(a))).alias("mse"))


def factor_contribution(loadings: DataFrame) -> DataFrame:
    """Share of squared loading by modality within each factor; input (factor, modality, feature, w)."""
    by = loadings.groupBy("factor", "modality").agg(F.sum(F.col("w") * F.col("w")).alias("ss"))
    tot = by.groupBy("factor").agg(F.sum("ss").alias("tot"))
    return by.join(tot, "factor").select("factor", "modality", (F.col("ss") / F.col("tot")).alias("share"))


def top_loadings(loadings: DataFrame, n: int) -> DataFrame:
    """Top ``n`` features by absolute loading per factor and modality."""
    return ranking.top_n(loadings, n, [F.abs("w").desc(), F.col("feature")], ["factor", "modality"])


def minmax01(df: DataFrame, column: str, impute: bool = True, eps: float = 1e-8) -> DataFrame:
    """NULL to the median, then (v - min) / (max - min + eps)."""
    v = F.col(column)
    if impute:
        v = F.coalesce(v, ranking.quantile_scalar(df.select(column), column, 0.5))
    s = stat(df, lo=F.min(column), hi=F.max(column))
    return df.withColumn(column, (v - s["lo"]) / (s["hi"] - s["lo"] + F.lit(eps)))


def rank01(df: DataFrame, column: str, out: str = "rank01") -> DataFrame:
    """Rank scaled to [0, 1]; ties share the lowest rank."""
    pre = ranking.prefix_counts(df, [], column)
    r = F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1)).otherwise(F.lit(0.0))
    return df.join(pre.select(column, r.alias(out)), column)


def noisy_rank01(df: DataFrame, column: str, key: str, level: float, seed: int = 0, out: str = "rank01") -> DataFrame:
    """Re-rank after adding level * N * hashed normal noise to the rank."""
    base = rank01(df, column, "_r")
    noisy = base.withColumn("_r", F.col("_r") + F.lit(level) * hashing.normal(key, seed=seed))
    return rank01(noisy, "_r", out).drop("_r")


def identify_tfs(features: DataFrame, tf_list: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Features named in the regulator list; the fallback list is used if that is empty; error if none."""
    hit = features.join(tf_list.select("feature").distinct(), "feature", "left_semi")
    if hit.isEmpty() and fallback is not None:
        hit = features.join(fallback.select("feature").distinct(), "feature", "left_semi")
    if hit.isEmpty():
        raise ValueError("no regulator of the list occurs among the features")
    return hit


def population_select(cells: DataFrame, q_src: float = 0.2, q_tgt: float = 0.8, column: str = "t") -> DataFrame:
    """Label rows source (<= low quantile), target (>= high quantile) or transit."""
    q = ranking.quantiles(cells, column, {"lo": q_src, "hi": q_tgt})
    q = q.select(F.struct("lo", "hi")).scalar()
    role = F.when(F.col(column) <= q["lo"], "source").when(F.col(column) >= q["hi"], "target").otherwise("transit")
    return cells.withColumn("role", role)


def population_by_label(cells: DataFrame, label: str, src: str, tgt: str) -> DataFrame:
    role = F.when(F.col(label) == src, "source").when(F.col(label) == tgt, "target").otherwise("transit")
    return cells.withColumn("role", role)


def binary_axis(cells: DataFrame, groupby: str, src: str, out: str = "t") -> DataFrame:
    """0 for the source label, 1 for every other row."""
    return cells.withColumn(out, F.when(F.col(groupby) == src, 0.0).otherwise(1.0))


def label_match_branches(cells: DataFrame, label: str, terms: dict[str, list[str]], key: str = "cell_id") -> DataFrame:
    """(key, branch) where the lower-cased label contains any of the branch's terms; rows may match several."""
    low = F.lower(label)
    hits = []
    for branch, words in terms.items():
        any_ = F.lit(False)
        for w in words:
            any_ = any_ | low.contains(w.lower())
        hits.append(F.when(any_, F.lit(branch)))
    return cells.select(key, F.explode(F.array_compact(F.array(*hits))).alias("branch"))


def ridge_loadings(latent: DataFrame, expr: DataFrame, dim: int, alpha: float = 1.0) -> DataFrame:
    """Ridge regression (with intercept) of every feature on the latent: (feature, w).

    Uses sums only: X'X centred from one aggregate, X'y per feature from the sparse triplets
    (zeros add nothing), and the D x D inverse applied as a column expression.
    """
    x = [F.col("x").getItem(i) for i in range(dim)]
    n, total, xx = second_moments(latent, "x", dim)
    mean = total / n
    xtx = xx - n * np.outer(mean, mean)
    inv = np.linalg.inv(xtx + alpha * np.eye(dim))
    per = expr.join(latent.select("cell_id", "x"), "cell_id").groupBy("feature").agg(
        F.array(*[F.sum(c * F.col("value")) for c in x]).alias("xy"), F.sum("value").alias("sy"))
    centred = F.zip_with("xy", literal(mean), lambda a, m: a - m * F.col("sy"))
    return per.select("feature", F.array(*[dot(centred, literal(r)) for r in inv]).alias("w"))


def branch_entropy(probs: DataFrame, key: str = "cell_id") -> DataFrame:
    p = F.col("prob")
    return probs.groupBy(key).agg(F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).alias("entropy"))


def fate_label(probs: DataFrame, q: float = 0.75, key: str = "cell_id", progenitor: str = "Progenitor") -> DataFrame:
    """Most probable branch per row; rows with entropy at or above its quantile become progenitors."""
    p = F.col("prob")
    per = probs.groupBy(key).agg(
        F.max_by("branch", F.struct(p, F.col("branch"))).alias("branch"),
        F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).alias("entropy"))
    cut = ranking.quantile_scalar(per, "entropy", q)
    return per.select(key, "entropy", F.when(F.col("entropy") >= cut, progenitor).otherwise(F.col("branch")).alias("fate"))


def force_include(selected: DataFrame, panel: DataFrame, available: DataFrame) -> DataFrame:
    """Selected features plus panel features present in the data; ``promoted`` marks the additions."""
    extra = (panel.select("feature").distinct().join(available.select("feature").distinct(), "feature", "left_semi")
             .join(selected, "feature", "left_anti"))
    return (selected.select("feature").distinct().withColumn("promoted", F.lit(False))
            .union(extra.withColumn("promoted", F.lit(True))))


def fate_from_day(cells: DataFrame, branches: list[str], day: str, label: str, cut: float) -> DataFrame:
    """Progenitor up to the cut day, afterwards the label if it is a branch, else Other."""
    fate = (F.when(F.col(day) <= cut, "Progenitor").when(F.col(label).isin(branches), F.col(label)).otherwise("Other"))
    return cells.withColumn("fate", fate)


def terminal_pure(probs: DataFrame, q: float = 0.98) -> DataFrame:
    """Rows per branch at or above the branch's own probability quantile."""
    cut = ranking.quantiles(probs, "prob", {"cut": q}, ["branch"])
    return probs.join(cut, "branch").where(F.col("prob") >= F.col("cut"))
