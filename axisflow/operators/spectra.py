"""Spectra of operators, factorisation of operator sequences, and projection to features.

Matrices are row-major ``array<double>``. Curves over the axis are (t_idx, t, ...) with one row per grid
point and key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing, ranking
from ..functions.gram import second_moments, summed
from ..functions.vectors import dot, dot_fixed
from ..session import cut_lineage

_SPECTRUM = "struct<re:array<double>,im:array<double>,lam:double,v:array<double>>"


def operator_spectrum(ops: DataFrame, dim: int, col: str = "j") -> DataFrame:
    """Eigenvalues (real part descending), largest real part and its unit eigenvector (real part) per operator.

    Batched over Arrow; no shuffle. Adds re, im, lam, v.
    """
    @F.pandas_udf(_SPECTRUM)
    def eig(j: pd.Series) -> pd.DataFrame:
        m = np.stack(j.to_numpy()).reshape(-1, dim, dim)
        w, vec = np.linalg.eig(m)
        order = np.lexsort((-w.imag, -w.real.round(12)), axis=-1)
        w = np.take_along_axis(w, order, axis=1)
        lead = np.take_along_axis(vec, order[:, None, :1], axis=2)[:, :, 0].real
        lead = lead / (np.linalg.norm(lead, axis=1, keepdims=True) + 1e-8)
        lead = lead * np.where(np.take_along_axis(lead, np.abs(lead).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
        return pd.DataFrame({"re": list(w.real), "im": list(w.imag), "lam": w.real[:, 0], "v": list(lead)})
    return ops.withColumn("_s", eig(col)).select(*ops.columns, "_s.re", "_s.im", "_s.lam", "_s.v")


def spectral_metrics(spectra: DataFrame, eps: float = 0.1) -> DataFrame:
    """lambda_max, lambda_min, plasticity (share of |Re| < eps) and stable_dim (count of Re < 0)."""
    near = F.size(F.filter("re", lambda r: F.abs(r) < eps))
    return spectra.withColumns({
        "lambda_max": F.array_max("re"), "lambda_min": F.array_min("re"),
        "plasticity": near / F.size("re"), "stable_dim": F.size(F.filter("re", lambda r: r < 0)).cast("double")})


def spectrum_features(spectra: DataFrame) -> DataFrame:
    """Eigenvalues by real part descending, as [Re..., Im...]."""
    pairs = F.sort_array(F.arrays_zip("re", "im"), asc=False)
    return spectra.withColumn("features", F.concat(pairs["re"], pairs["im"]))


EXACT_WIDTH = 64  # widths up to this take all second moments, beyond it a randomised range
OVERSAMPLE = 10


def fit_embedding(df: DataFrame, col: str, dim: int, n: int, exact_width: int = EXACT_WIDTH, passes: int = 40, tol: float = 1e-9, seed: int = 0) -> dict:
    """PCA of flattened operators or spectrum features; {'mean', 'components', 'ratio'}.

    Wide columns are fitted by subspace iteration from a random range: a pass sums dim x (n + oversampling) products and
    not dim x dim, and passes end when the variances of the n components settle.
    """
    n = min(n, dim)
    if dim <= exact_width:
        rows, total, xx = second_moments(df, col, dim)
        mean = total / rows
        vals, vecs = np.linalg.eigh(xx / rows - np.outer(mean, mean))
        order = np.argsort(vals)[::-1][:n]
        comp, top, whole = vecs[:, order].T, vals[order], vals.sum()
    else:
        data = cut_lineage(df.select(col))
        base = summed(data, lambda pdf: np.concatenate([[len(pdf)], np.stack(pdf[col]).sum(0), (np.stack(pdf[col]) ** 2).sum(0)]), 1 + 2 * dim)
        rows, mean = base[0], base[1:1 + dim] / base[0]
        whole = (base[1 + dim:] / rows - mean * mean).sum()
        width = min(dim, n + OVERSAMPLE)
        q, before = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, width)))[0], None
        for _ in range(passes):
            def product(pdf: pd.DataFrame, q=q) -> np.ndarray:
                x = np.stack(pdf[col]) - mean
                return (x.T @ (x @ q)).ravel()
            cq = summed(data, product, dim * width).reshape(dim, width) / rows
            small = q.T @ cq
            vals, vecs = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(vals)[::-1][:n]
            comp, top = (q @ vecs[:, order]).T, vals[order]
            if before is not None and np.abs(top - before).max() <= tol * max(top.max(), 1e-300):
                break
            before, q = top, np.linalg.qr(cq)[0]
    comp = comp * np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(axis=1)])[:, None]
    return {"mean": mean, "components": comp, "ratio": top / max(whole, 1e-300)}


def embed(df: DataFrame, col: str, model: dict, out: str = "z") -> DataFrame:
    """Coordinates under a fitted embedding; applies to new rows as well."""
    mean, comp = model["mean"], model["components"]

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(x.to_numpy()) - mean) @ comp.T))
    return df.withColumn(out, project(col))


def operator_embedding(df: DataFrame, method: str, n: int, dim: int) -> tuple[DataFrame, dict | None]:
    """Embed by 'pca' (column j), 'spectrum' (column features) or 'metrics' (the four metrics; raw if n >= 4)."""
    if method == "metrics":
        four = F.array("lambda_max", "lambda_min", "plasticity", "stable_dim")
        df = df.withColumn("features", four)
        if n >= 4:
            return df.withColumn("z", F.col("features")), None
        model = fit_embedding(df, "features", 4, n)
        return embed(df, "features", model), model
    if method not in ("pca", "spectrum"):
        raise ValueError("method must be 'pca', 'spectrum' or 'metrics'")
    col = "j" if method == "pca" else "features"
    model = fit_embedding(df, col, dim, n)
    return embed(df, col, model), model


def _block_step(edges: DataFrame, basis: DataFrame, width: int, last: int) -> DataFrame:
    """(i, v, w): the basis with the operator's image of its last ``last`` columns."""
    cols = [F.col("v")[width - last + k].alias(f"_c{k}") for k in range(last)]
    image = (edges.join(basis.select(F.col("i").alias("j"), *cols), "j").groupBy("i")
             .agg(F.array(*[F.sum(F.col("v") * F.col(f"_c{k}")) for k in range(last)]).alias("w")))
    return basis.join(image, "i", "left").select("i", "v", F.coalesce("w", F.array(*[F.lit(0.0)] * last)).alias("w"))


def _gram(df: DataFrame, width: int) -> np.ndarray:
    def part(pdf: pd.DataFrame) -> np.ndarray:
        z = np.hstack([np.stack(pdf["v"]), np.stack(pdf["w"])])
        return (z.T @ z).ravel()
    return summed(df.select("v", "w"), part, width * width).reshape(width, width)


def _combined(df: DataFrame, keep: np.ndarray, new: np.ndarray, out: str) -> DataFrame:
    """Column ``out`` = v @ keep + w @ new."""
    @F.pandas_udf("array<double>")
    def apply(v: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()) @ keep + np.stack(w.to_numpy()) @ new))
    return df.withColumn(out, apply("v", "w"))


def leading_modes(edges: DataFrame, n: int = 2, block: int = 4, steps: int = 6, restarts: int = 20, tol: float = 1e-8, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """Leading eigenpairs by modulus of a sparse square operator (i, j, v) that need not fit one host.

    Block Krylov steps build an orthonormal basis that stays distributed; only its small projected matrix reaches the
    driver. Complex pairs come out as such. Returns (i, mode, re, im), each mode of unit norm with its largest entry
    real and positive, and per mode {'re', 'im', 'residual'}, the residual relative to the modulus; it restarts from
    the modes found until all residuals are at most ``tol``.
    """
    edges = cut_lineage(edges.groupBy("i", "j").agg(F.sum("v").alias("v")))
    nodes = edges.select("i").union(edges.select("j")).distinct()
    start = F.array(*[hashing.normal(F.col("i").cast("string"), F.lit(k), seed=seed) for k in range(block)])
    basis = cut_lineage(nodes.select("i", F.array().cast("array<double>").alias("v"), start.alias("w")))
    found: list[dict] = []
    for _ in range(restarts):
        width, h = 0, np.zeros((0, 0))
        sizes, coupling = [], None
        for step in range(steps + 1):
            fresh = basis.select(F.size("w").alias("s")).first()["s"]
            c_all, r_all = np.zeros((width, fresh)), np.eye(fresh)
            for _ in range(2):  # twice, so that rounding leaves no trace of the old columns
                g = _gram(basis, width + fresh)
                c, rest = g[:width, width:], g[width:, width:] - g[:width, width:].T @ g[:width, width:]
                vals, vecs = np.linalg.eigh((rest + rest.T) / 2)
                held = vals > 1e-20 * max(np.trace(g[width:, width:]), 1e-300)
                c_all = c_all + c @ r_all
                if not held.any():
                    break
                scale = vecs[:, held] / np.sqrt(vals[held])
                r_all = (np.sqrt(vals[held])[:, None] * vecs[:, held].T) @ r_all
                basis = cut_lineage(_combined(basis, -c @ scale, scale, "w").select("i", "v", "w"))
                fresh = int(held.sum())
            done = not held.any()
            if sizes:  # the image of the last block in terms of the basis
                grown = np.zeros((width + (0 if done else fresh), width))
                grown[:h.shape[0], :h.shape[1]] = h
                grown[:width, width - sizes[-1]:] = c_all
                if not done:
                    grown[width:, width - sizes[-1]:] = r_all
                h, coupling = grown, (np.zeros((1, sizes[-1])) if done else r_all)
            if done or step == steps:
                break
            basis = basis.select("i", F.concat("v", "w").alias("v"))
            width += fresh
            sizes.append(fresh)
            basis = cut_lineage(_block_step(edges, basis, width, fresh))
        vals, vecs = np.linalg.eig(h[:width, :width])
        order = sorted(range(len(vals)), key=lambda k: (-round(abs(vals[k]), 9), -vals[k].real, -vals[k].imag))[:n]
        found = [{"re": float(vals[k].real), "im": float(vals[k].imag),
                  "residual": float(np.linalg.norm(coupling @ vecs[width - sizes[-1]:, k]) / max(abs(vals[k]), 1e-300))} for k in order]
        parts = np.concatenate([np.stack([vecs[:, k].real, vecs[:, k].imag], 1) for k in order], 1)
        if all(f["residual"] <= tol for f in found):
            break
        again = [parts[:, c] for c in range(parts.shape[1]) if np.linalg.norm(parts[:, c]) > 1e-12][:max(block, 2 * n)]
        mix = np.stack(again, 1)
        basis = cut_lineage(_combined(basis.select("i", "v", F.array(F.lit(0.0)).alias("w")), mix, np.zeros((1, mix.shape[1])), "z").select("i", F.array().cast("array<double>").alias("v"), F.col("z").alias("w")))
    at = _combined(basis.select("i", "v", F.array(F.lit(0.0)).alias("w")), parts, np.zeros((1, parts.shape[1])), "z")
    pairs = F.array(*[F.struct(F.lit(m).alias("mode"), F.col("z")[2 * m].alias("a"), F.col("z")[2 * m + 1].alias("b")) for m in range(len(order))])
    long = cut_lineage(at.select("i", F.explode(pairs).alias("p")).select("i", "p.mode", "p.a", "p.b"))
    size = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    top = long.groupBy("mode").agg(F.max_by(F.struct("a", "b"), F.struct(F.round(size, 12), F.col("i"))).alias("t"), F.sqrt(F.sum(size)).alias("n"))
    unit = F.sqrt(F.col("t.a") * F.col("t.a") + F.col("t.b") * F.col("t.b")) * F.col("n")
    re = (F.col("a") * F.col("t.a") + F.col("b") * F.col("t.b")) / unit  # turned by the conjugate of the largest entry
    im = (F.col("b") * F.col("t.a") - F.col("a") * F.col("t.b")) / unit
    return long.join(top, "mode").select("i", "mode", re.alias("re"), im.alias("im")), found


def dominant_mode(edges: DataFrame, tol: float = 1e-8, **kw) -> DataFrame:
    """The eigenvector of largest modulus of a sparse square operator (i, j, v): (i, x), unit norm, its largest entry positive.

    An error says so if that mode is one of a complex pair; :func:`leading_modes` gives those.
    """
    modes, found = leading_modes(edges, 1, tol=tol, **kw)
    if abs(found[0]["im"]) > tol * abs(found[0]["re"]) + 1e-300:
        raise ValueError("the dominant mode is one of a complex pair")
    return modes.select("i", F.col("re").alias("x"))


def rayleigh(edges: DataFrame, mode: DataFrame) -> DataFrame:
    """Eigenvalue estimate x'Ax / x'x."""
    ax = (edges.join(mode.select(F.col("i").alias("j"), F.col("x").alias("xj")), "j")
          .groupBy("i").agg(F.sum(F.col("v") * F.col("xj")).alias("ax")).join(mode, "i"))
    den = mode.agg(F.sum(F.col("x") * F.col("x")).alias("n")).scalar()
    return ax.agg((F.sum(F.col("ax") * F.col("x")) / den).alias("lambda"))


def semi_nmf_models(rows: DataFrame, inits: list, rank: int, width: int, iters: int = 500, tol: float = 1e-4, col: str = "m") -> tuple[list[np.ndarray], list[float]]:
    """H and error of one factorisation M ~ W H, W >= 0, per entry of ``inits``, columns with the first weights of a row.

    Given H, a row's weights depend on that row only, so a round is one pass that rebuilds W and sums W'W and W'M for
    all models together. Only those K x K and K x width sums reach the driver; a model that has settled leaves the pass.
    """
    block, models = rank * rank + rank * width, len(inits)

    def solved(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wtw, wtm = part[:rank * rank].reshape(rank, rank), part[rank * rank:].reshape(rank, width)
        return wtw, wtm, np.linalg.solve(wtw + 1e-6 * np.eye(rank), wtm)

    def sums_of(w: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
        return [(w.T @ w).ravel(), (w.T @ m).ravel()]
    start = rows.select(col, *[w.alias(f"w{s}") for s, w in enumerate(inits)])

    def first(pdf: pd.DataFrame) -> np.ndarray:
        m = np.stack(pdf[col])
        return np.concatenate([x for s in range(models) for x in sums_of(np.stack(pdf[f"w{s}"]), m)] + [np.array([(m * m).sum()])])
    sums = summed(start, first, models * block + 1)
    total, data = sums[-1], rows.select(col)
    hs = [solved(sums[s * block:(s + 1) * block])[2] for s in range(models)]
    errors, open_ = [np.inf] * models, list(range(models))
    for _ in range(iters):
        maps = [hs[s].T @ np.linalg.inv(hs[s] @ hs[s].T + 1e-6 * np.eye(rank)) for s in open_]

        def step(pdf: pd.DataFrame, maps=maps) -> np.ndarray:
            m = np.stack(pdf[col])
            return np.concatenate([x for a in maps for x in sums_of(np.maximum(m @ a, 0.0), m)])
        sums, going = summed(data, step, len(open_) * block), []
        for at, s in enumerate(open_):
            wtw, wtm, better = solved(sums[at * block:(at + 1) * block])
            err = float(np.sqrt(max(total - 2 * (hs[s] * wtm).sum() + (wtw * (hs[s] @ hs[s].T)).sum(), 0.0)))
            settled = np.isfinite(errors[s]) and abs(errors[s] - err) / (errors[s] + 1e-8) < tol
            errors[s] = err
            if not settled:
                hs[s] = better
                going.append(s)
        open_ = going
        if not open_:
            break
    return hs, errors


def nmf_weights(h: np.ndarray) -> np.ndarray:
    """The matrix that gives a row's weights under H, before negative ones are cut off."""
    return h.T @ np.linalg.inv(h @ h.T + 1e-6 * np.eye(len(h)))


def nmf_start(key, rank: int, seed: int) -> Column:
    """First weights of a row, hashed from its key."""
    return F.array(*[F.abs(hashing.normal(key, F.lit(k), seed=seed)) + F.lit(1e-4) for k in range(rank)])


def semi_nmf(rows: DataFrame, rank: int, width: int, iters: int = 500, restarts: int = 5, tol: float = 1e-4,
             key: str = "t_idx", col: str = "m", seed: int = 0) -> tuple[DataFrame, np.ndarray, float]:
    """M ~ W H with W >= 0: (rows with ``w``, H, error), the best of several starts that share every pass."""
    rows = cut_lineage(rows)  # every round reads it
    hs, errors = semi_nmf_models(rows, [nmf_start(F.col(key), rank, seed + s) for s in range(restarts)], rank, width, iters, tol, col)
    best = int(np.argmin(errors))
    a = nmf_weights(hs[best])

    @F.pandas_udf("array<double>")
    def weights(m: pd.Series) -> pd.Series:
        return pd.Series(list(np.maximum(np.stack(m.to_numpy()) @ a, 0.0)))
    return rows.withColumn("w", weights(col)), hs[best], errors[best]


def activations(factored: DataFrame, rank: int, keys: list[str] = ("t_idx", "t")) -> DataFrame:
    """Long (keys, k, a) from the weight arrays of :func:`semi_nmf`."""
    return factored.select(*keys, F.posexplode("w").alias("k", "a"))


def svd_modes(columns: DataFrame, n_rows: int, rank: int, col: str = "m", centre: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Truncated SVD of a wide matrix held as one row per column: ``m`` has the ``n_rows`` entries of a column.

    The long side stays distributed: the n_rows x n_rows Gram is one sum, its eigenvectors are the left modes,
    and the right vectors are a row expression. Returns (columns with ``v``, U, S).
    """
    def part(pdf: pd.DataFrame) -> np.ndarray:
        m = np.stack(pdf[col])
        if centre:
            m = m - m.mean(axis=1, keepdims=True)
        return (m.T @ m).ravel()
    gram = summed(columns.select(col), part, n_rows * n_rows).reshape(n_rows, n_rows)
    vals, vecs = np.linalg.eigh(gram)
    order = np.argsort(vals)[::-1]
    vals = np.maximum(vals[order], 0.0)
    u = vecs[:, order][:, :rank]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    s = np.sqrt(vals)
    a = u / np.maximum(s[:rank], 1e-12)

    @F.pandas_udf("array<double>")
    def right(m: pd.Series) -> pd.Series:
        x = np.stack(m.to_numpy())
        if centre:
            x = x - x.mean(axis=1, keepdims=True)
        return pd.Series(list(x @ a))
    return columns.withColumn("v", right(col)), u, s


def reconstruction_r2(observed: DataFrame, fitted: DataFrame, on: list[str], keys: list[str] = ()) -> DataFrame:
    """max(0, 1 - SSE / (SST + 1e-8)) with uncentred SST, from (on, v) and (on, v_hat)."""
    j = observed.join(fitted, list(on))
    sse, sst = F.sum(F.pow(F.col("v") - F.col("v_hat"), 2)), F.sum(F.col("v") * F.col("v"))
    return j.groupBy(*keys).agg(F.greatest(F.lit(0.0), 1.0 - sse / (sst + F.lit(1e-8))).alias("r2"))


def normalise_activations(act: DataFrame, keys: list[str] = ("k",), col: str = "a") -> DataFrame:
    """a / (max a + 1e-8) per archetype."""
    top = act.groupBy(*keys).agg(F.max(col).alias("_m"))
    return act.join(top, list(keys)).withColumn(col, F.col(col) / (F.col("_m") + F.lit(1e-8))).drop("_m")


def activation_correlation(act: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Pearson correlation over t of every ordered archetype pair: (keys, k1, k2, r).

    Archetypes per key are few (the rank of the factorisation) and t is the grid.
    """
    keys = list(keys)
    a = act.select(*keys, "t_idx", F.col("k").alias("k1"), F.col("a").alias("a1"))
    b = act.select(*keys, "t_idx", F.col("k").alias("k2"), F.col("a").alias("a2"))
    return a.join(b, [*keys, "t_idx"]).groupBy(*keys, "k1", "k2").agg(F.corr("a1", "a2").alias("r"))


def sign_align(vectors: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Flip each vector (t_idx, lam, v) to agree with the previous one; rows with lam <= 0 become zero and restart.

    The sign is the parity of negative dot products met since the last restart.
    """
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    w = part.orderBy("t_idx")
    ok = F.col("lam") > 0
    d = vectors.withColumn("_island", F.sum(F.when(ok, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_pv", F.lag("v").over(w)).withColumn("_pl", F.lag("lam").over(w))
    neg = F.when(ok & (F.col("_pl") > 0) & (dot("v", "_pv") < 0), 1).otherwise(0)
    d = d.withColumn("_neg", neg)
    isl = (W.partitionBy(*keys, "_island") if keys else W.partitionBy("_island")).orderBy("t_idx")
    d = d.withColumn("_flips", F.sum("_neg").over(isl.rowsBetween(W.unboundedPreceding, 0)))
    sign = F.when(~ok, 0.0).when(F.col("_flips") % 2 == 1, -1.0).otherwise(1.0)
    d = d.withColumn("sign", sign)
    return d.withColumn("v", F.transform("v", lambda a: a * F.col("sign"))).drop("_island", "_pv", "_pl", "_neg", "_flips")


def project_features(vectors: DataFrame, loadings: DataFrame, dim: int, keys: list[str] = ("t_idx",)) -> DataFrame:
    """score = loadings . v for every grid point and feature: (keys, feature, score).

    The vectors (one per grid point, size bounded by grid x dim) are packed into one array that every
    loading row walks; the feature table is never shuffled.
    """
    packed = vectors.agg(F.collect_list(F.struct(*keys, "v")).alias("p")).scalar()
    e = loadings.withColumn("_p", packed).select("feature", "w", F.explode("_p").alias("q"))
    return e.select(*[F.col(f"q.{k}").alias(k) for k in keys], "feature", dot_fixed("w", "q.v", dim).alias("score"))


def _n_sensitive(lam: DataFrame, thr: float, keys: list[str]) -> DataFrame:
    return lam.where(F.col("lam") > thr).groupBy(*keys).agg(F.count_distinct("t_idx").alias("_ns"))


def global_feature_rank(track: DataFrame, lam: DataFrame, top: int = 50, thr: float = 0.0) -> DataFrame:
    """Mean absolute score over sensitive t (absent = 0), top features with rank."""
    sens = lam.where(F.col("lam") > thr).select("t_idx")
    ns = sens.agg(F.count(F.lit(1)).alias("n")).scalar()
    s = track.join(F.broadcast(sens), "t_idx").groupBy("feature").agg((F.sum(F.abs("score")) / ns).alias("mean_score"))
    return ranking.top_n(s, top, [F.col("mean_score").desc(), F.col("feature")])


def active_grid(act: DataFrame, lam: DataFrame, q: float = 0.75, thr: float = 0.0) -> DataFrame:
    """(k, t_idx, n_active): sensitive grid points at or above the archetype's own activation quantile."""
    cut = act.groupBy("k").agg(F.percentile("a", q).alias("cut"))  # one curve of grid length per archetype
    on = act.join(cut, "k").where(F.col("a") >= F.col("cut")).join(lam.where(F.col("lam") > thr).select("t_idx"), "t_idx", "left_semi")
    n = on.groupBy("k").agg(F.count(F.lit(1)).alias("n_active"))
    return on.join(n, "k").select("k", "t_idx", "n_active")


def archetype_feature_score(track: DataFrame, act: DataFrame, lam: DataFrame, q: float = 0.75, thr: float = 0.0) -> DataFrame:
    """Mean absolute score by archetype and feature over the archetype's active, sensitive grid points."""
    on = active_grid(act, lam, q, thr)  # at most archetypes x grid rows
    return (track.join(F.broadcast(on), "t_idx").groupBy("k", "feature", "n_active").agg(F.sum(F.abs("score")).alias("_s"))
            .select("k", "feature", (F.col("_s") / F.col("n_active")).alias("mean_score")))


def archetype_feature_rank(track: DataFrame, act: DataFrame, lam: DataFrame, top: int = 50, q: float = 0.75) -> DataFrame:
    return ranking.top_n(archetype_feature_score(track, act, lam, q), top, [F.col("mean_score").desc(), F.col("feature")], ["k"])


def instability_table(track: DataFrame, act: DataFrame, lam: DataFrame, n_features: int = 20, activation_threshold: float = 0.5,
                      sensitivity_threshold: float = 0.05, min_sensitive_fraction: float = 0.1, top_archetypes: int | None = None) -> DataFrame:
    """Archetype statistics joined to the archetype's ranked features."""
    a = act.join(lam.select("t_idx", "lam"), "t_idx")
    on = F.col("a") > activation_threshold
    st = a.groupBy("k").agg(
        F.avg(F.when(on, F.col("lam"))).alias("mean_sensitivity"),
        F.avg(F.when(on, F.when(F.col("lam") > sensitivity_threshold, 1.0).otherwise(0.0))).alias("sensitive_fraction"),
        F.max_by("t", F.struct("a", -F.col("t_idx"))).alias("peak_t"), F.sum(F.when(on, 1).otherwise(0)).alias("_n"))
    st = st.where((F.col("_n") > 0) & (F.col("sensitive_fraction") >= min_sensitive_fraction)).drop("_n")
    if top_archetypes is not None:
        st = ranking.top_n(st, top_archetypes, [F.col("mean_sensitivity").desc(), F.col("k")], [], "_r").drop("_r")
    feats = archetype_feature_rank(track, act, lam, n_features)
    return st.join(feats, "k").select("k", "mean_sensitivity", "sensitive_fraction", "peak_t", "feature", F.col("mean_score").alias("score"), "rank")


def feature_peak_table(track: DataFrame, act: DataFrame, lam: DataFrame, n: int, thr: float = 0.05) -> DataFrame:
    """Top features with the t of their largest absolute score among sensitive t and the archetype most active there."""
    top = global_feature_rank(track, lam, n, 0.0)
    sens = lam.where(F.col("lam") > thr).select("t_idx", "t")
    s = F.abs("score")
    pk = (track.join(top, "feature").join(F.broadcast(sens), "t_idx").groupBy("feature", "rank", "mean_score")
          .agg(F.max_by(F.struct("t_idx", "t"), F.struct(s, -F.col("t_idx"))).alias("p")))
    arch = act.groupBy("t_idx").agg(F.min_by("k", F.struct(-F.col("a"), F.col("k"))).alias("archetype"))
    return (pk.select("feature", "rank", "mean_score", "p.t_idx", F.col("p.t").alias("peak_t"))
            .join(arch, "t_idx", "left").drop("t_idx"))


def feature_by_archetype(track: DataFrame, act: DataFrame, lam: DataFrame, names: list, n: int, q: float = 0.75) -> DataFrame:
    """Mean absolute score of the top features (rows) by archetype (columns), 0 where none."""
    top = global_feature_rank(track, lam, n).select("feature")
    m = archetype_feature_score(track, act, lam, q).join(top, "feature", "left_semi")
    return m.groupBy("feature").pivot("k", names).agg(F.first("mean_score")).na.fill(0.0)


def bridge_feature_table(track: DataFrame, act: DataFrame, lam: DataFrame, n: int, act_thr: float = 0.5, sens_thr: float = 0.0) -> DataFrame:
    """Per direction and archetype: mean absolute projection over active sensitive t, or all sensitive t if none; top n.

    Inputs carry ``direction``: track (direction, t_idx, feature, score), act (direction, k, t_idx, t, a), lam (direction, t_idx, lam).
    """
    a = act.join(lam.select("direction", "t_idx", "lam"), ["direction", "t_idx"])
    s, on = F.col("lam") > sens_thr, (F.col("a") >= act_thr) & (F.col("lam") > sens_thr)
    part = W.partitionBy("direction", "k")
    a = a.withColumn("_n_on", F.sum(F.when(on, 1).otherwise(0)).over(part))
    use = a.where(F.when(F.col("_n_on") > 0, on).otherwise(s))
    st = use.groupBy("direction", "k").agg(F.avg("lam").alias("mean_sensitivity"), F.count(F.lit(1)).alias("_n"))
    pk = act.groupBy("direction", "k").agg(F.max_by("t", F.struct("a", -F.col("t_idx"))).alias("peak_t"))
    sc = (track.join(use.select("direction", "k", "t_idx"), ["direction", "t_idx"])
          .groupBy("direction", "k", "feature").agg(F.sum(F.abs("score")).alias("_s")).join(st, ["direction", "k"])
          .select("direction", "k", "feature", "mean_sensitivity", (F.col("_s") / F.col("_n")).alias("score")))
    top = ranking.top_n(sc, n, [F.col("score").desc(), F.col("feature")], ["direction", "k"])
    return top.join(pk, ["direction", "k"])


def filter_bridge_features(table: DataFrame, n: int | None = None, top_archetypes: int | None = None) -> DataFrame:
    """Rank limit, then the archetypes of highest mean sensitivity per direction."""
    out = table.where(F.col("rank") <= n) if n else table
    if top_archetypes:
        m = out.groupBy("direction", "k").agg(F.avg("mean_sensitivity").alias("_m"))
        keep = ranking.top_n(m, top_archetypes, [F.col("_m").desc(), F.col("k")], ["direction"], "_r")
        out = out.join(keep.select("direction", "k"), ["direction", "k"], "left_semi")
    return out


def direction_asymmetry(forward: DataFrame, backward: DataFrame, value: str = "lam") -> DataFrame:
    """Forward minus backward curve by grid point."""
    b = backward.select("t_idx", F.col(value).alias("_b"))
    return forward.join(b, "t_idx").select("t_idx", "t", (F.col(value) - F.col("_b")).alias("asymmetry"))


def archetype_profile(act: DataFrame, n_eff: DataFrame, scores: DataFrame, markers: list, n: int = 20) -> DataFrame:
    """Peak t, n_eff there, boundary flag, amplitude, top features by |score| and marker hits per archetype."""
    pk = act.groupBy("k").agg(F.max_by(F.struct("t_idx", "t"), F.struct("a", -F.col("t_idx"))).alias("p"), F.max("a").alias("amplitude"))
    pk = pk.select("k", "p.t_idx", F.col("p.t").alias("peak_t"), "amplitude").join(n_eff.select("t_idx", "n_eff"), "t_idx", "left")
    top = ranking.top_n(scores, n, [F.abs("score").desc(), F.col("feature")], ["k"])
    top = top.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("rank", "feature"))).alias("_f")).select("k", F.col("_f.feature").alias("features"))
    hits = F.size(F.array_intersect("features", F.array(*[F.lit(m) for m in markers])))
    return (pk.join(top, "k").select("k", "peak_t", F.col("n_eff").alias("n_eff_at_peak"),
                                     ((F.col("peak_t") < 0.05) | (F.col("peak_t") > 0.95)).alias("is_boundary"), "amplitude", "features", hits.alias("hits")))


def handoffs(act: DataFrame, r_max: float = -0.5) -> DataFrame:
    """For archetype pairs with r below ``r_max``, the t at each sign change of their difference."""
    pairs = activation_correlation(act).where((F.col("k1") < F.col("k2")) & (F.col("r") < r_max))
    a = act.select("t_idx", "t", F.col("k").alias("k1"), F.col("a").alias("a1"))
    b = act.select("t_idx", F.col("k").alias("k2"), F.col("a").alias("a2"))
    d = pairs.join(a, "k1").join(b, ["k2", "t_idx"]).withColumn("_s", F.signum(F.col("a1") - F.col("a2")))
    w = W.partitionBy("k1", "k2").orderBy("t_idx")
    return d.withColumn("_n", F.lead("_s").over(w)).where(F.col("_n") != F.col("_s")).select("k1", "k2", "r", "t")


def leading_eigenvalue_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Largest real part of the eigenvalues of [[a, b], [c, d]] without Python."""
    half, disc = (a + d) / 2, F.pow((a - d) / 2, 2) + b * c
    return F.when(disc >= 0, half + F.sqrt(disc)).otherwise(half)
