"""Direction fields along the axis and local linear operators fitted to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stat
from ..functions.vectors import add, dot, literal, mean_vectors, norm, sub, sum_vectors, unit, vec_sum


def _divide(df: DataFrame, col: str, by: Column) -> DataFrame:
    return df.withColumn("_by", by).withColumn(col, F.zip_with(col, F.array_repeat("_by", F.size(col)), lambda a, b: a / b)).drop("_by")


def pseudotime_velocity(edges: DataFrame, cells: DataFrame, dim: int) -> DataFrame:
    """Mean displacement to later neighbours weighted by the time gap, divided by the mean norm.

    ``cells`` is (cell_id, t, x); rows without a later neighbour get the zero vector: (cell_id, v).
    """
    c = cells.select("cell_id", "t", "x")
    e = (edges.select("src", "dst")
         .join(c.select(F.col("cell_id").alias("src"), F.col("t").alias("ti"), F.col("x").alias("xi")), "src")
         .join(c.select(F.col("cell_id").alias("dst"), F.col("t").alias("tj"), F.col("x").alias("xj")), "dst"))
    e = e.withColumn("_dt", F.col("tj") - F.col("ti")).where(F.col("_dt") > 0).withColumn("_d", sub("xj", "xi"))
    s = e.groupBy("src").agg(sum_vectors("_d", dim, F.col("_dt")).alias("_s"), F.sum("_dt").alias("_w"))
    v = F.transform("_s", lambda a: a / F.col("_w"))
    zero = literal([0.0] * dim)
    raw = (c.select("cell_id").join(s.select(F.col("src").alias("cell_id"), v.alias("v")), "cell_id", "left")
           .withColumn("v", F.coalesce("v", zero)))
    m = stat(raw, m=F.avg(norm("v")))
    return _divide(raw, "v", m["m"] + F.lit(1e-8))


def biased_velocity(velocity: DataFrame, cells: DataFrame, terminal: Column, strength: float = 1.0,
                    progenitor: Column | None = None) -> DataFrame:
    """Velocity plus strength * t * unit direction to the terminal centroid, rescaled to unit mean norm.

    With ``progenitor`` the direction is first projected on the progenitor-to-terminal axis.
    """
    df = velocity.select("cell_id", "v").join(cells.select("cell_id", "t", "x"), "cell_id")
    df = df.withColumn("_term", terminal).withColumn("_dir", sub("_term", "x"))
    if progenitor is not None:
        df = df.withColumn("_prog", progenitor).withColumn("_ax", unit(sub("_term", "_prog")))
        df = df.withColumn("_p", dot("_dir", "_ax")).withColumn("_dir", F.transform("_ax", lambda a: a * F.col("_p")))
    df = df.withColumn("_n", norm("_dir") + F.lit(1e-8))
    pull = F.transform("_dir", lambda a: a / F.col("_n") * F.col("t") * F.lit(float(strength)))
    raw = df.select("cell_id", add("v", pull).alias("v"))
    m = stat(raw, m=F.avg(norm("v")))
    return _divide(raw, "v", m["m"] + F.lit(1e-8))


def centroids(latent: DataFrame, by: str, dim: int, vec: str = "x") -> DataFrame:
    """Mean vector and row count per label."""
    return latent.groupBy(by).agg(mean_vectors(vec, dim).alias("centroid"), F.count(F.lit(1)).alias("n"))


def centroid_of(latent: DataFrame, condition: Column, dim: int) -> Column:
    """Mean vector of the selected rows as a scalar subquery."""
    return latent.where(condition).agg(mean_vectors("x", dim).alias("c")).scalar()


def axis_alignment(velocity: DataFrame, axis: Column, dim: int) -> DataFrame:
    """Mean velocity projected on the unit axis."""
    m = velocity.agg(mean_vectors("v", dim).alias("m")).withColumn("_a", axis)
    return m.select(dot("m", unit("_a")).alias("alignment"))


def time_gate(mode: str, t: str = "t") -> Column:
    """Weight of the prior along the axis."""
    x = F.col(t)
    gates = {"flat": F.lit(1.0), "root": 1.0 - x, "rise": x, "mid": 4.0 * x * (1.0 - x)}
    if mode not in gates:
        raise ValueError(f"mode must be one of {sorted(gates)}")
    return gates[mode]


def prior_drift(interpolated: DataFrame, cells: DataFrame, strength: float = 1.0, conf_power: float = 1.0, mode: str = "flat") -> DataFrame:
    """scale * conf^p * gate(t) * v for rows of (src, v, conf)."""
    df = interpolated.join(cells.select(F.col("cell_id").alias("src"), "t"), "src")
    df = df.withColumn("_g", F.lit(float(strength)) * F.pow("conf", F.lit(float(conf_power))) * time_gate(mode))
    return df.select("src", F.transform("v", lambda a: a * F.col("_g")).alias("drift"))


def field_energy(velocity: DataFrame) -> DataFrame:
    """Mean squared component."""
    return velocity.agg((F.sum(vec_sum(F.transform("v", lambda a: a * a))) / F.sum(F.size("v"))).alias("energy"))


def grid_flow(points: DataFrame, bins: int = 20, min_rows: int = 3) -> DataFrame:
    """Mean 2-D velocity on a regular grid over (px, py, vx, vy); cells with fewer rows are left out."""
    s = stat(points, x0=F.min("px"), x1=F.max("px"), y0=F.min("py"), y1=F.max("py"))
    def cell(p, lo, hi):
        return F.least(F.floor(F.coalesce(F.try_divide(F.col(p) - lo, hi - lo), F.lit(0.0)) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    df = points.select("vx", "vy", cell("px", s["x0"], s["x1"]).alias("ix"), cell("py", s["y0"], s["y1"]).alias("iy"))
    return (df.groupBy("ix", "iy").agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_rows))


HELD_MOMENTS = 4_000_000  # numbers of all keys that a task adds up before it hands them on


def _moments(pdf: pd.DataFrame, grid: np.ndarray, h: float, dim: int) -> np.ndarray:
    """Kernel-weighted sums of a batch for all grid points."""
    x, v = np.stack(pdf["x"]), np.stack(pdf["v"])
    w = np.exp(-0.5 * ((grid[:, None] - pdf["t"].to_numpy()[None, :]) / h) ** 2)
    if "_w" in pdf:
        w = w * pdf["_w"].to_numpy()[None, :]
    n = len(pdf)
    block = np.concatenate([np.ones((n, 1)), x, v,
                            (x[:, :, None] * x[:, None, :]).reshape(n, -1),
                            (x[:, :, None] * v[:, None, :]).reshape(n, -1)], axis=1)
    return w @ block


def _weighted_moments(grid: np.ndarray, h: float, dim: int, keys: list[str] = ()):
    """Sums per task: one row per key and grid point. A task with very many keys hands on what it has and goes on."""
    shape = (len(grid), 1 + 2 * dim + 2 * dim * dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pd.DataFrame]:
            for key, acc in held.items():
                names = {c: [k] * len(grid) for c, k in zip(keys, key)}
                yield pd.DataFrame({**names, "t_idx": np.arange(len(grid), dtype="int32"), "m": list(acc)})
            held.clear()

        for pdf in batches:
            groups = pdf.groupby(list(keys), sort=False, dropna=False) if keys else [((), pdf)]
            for key, part in groups:
                if not len(part):
                    continue
                if key not in held:
                    if (len(held) + 1) * shape[0] * shape[1] > HELD_MOMENTS:
                        yield from out()
                    held[key] = np.zeros(shape)
                held[key] += _moments(part, grid, h, dim)
        yield from out()
    return run


def _solve(m: np.ndarray, dim: int, ridge: float) -> np.ndarray:
    """Weighted ridge regression of v on x (intercept by centring); returns J with v ~ J x + c."""
    w = max(m[0], 1e-300)
    mx, mv = m[1:1 + dim] / w, m[1 + dim:1 + 2 * dim] / w
    at = 1 + 2 * dim
    sxx = m[at:at + dim * dim].reshape(dim, dim) / w - np.outer(mx, mx)
    sxv = m[at + dim * dim:].reshape(dim, dim) / w - np.outer(mx, mv)
    return np.linalg.solve(sxx + ridge * np.eye(dim), sxv).T


def local_linear_operator(cells: DataFrame, grid: list[float], h: float, dim: int, ridge: float = 1e-3,
                          keys: list[str] = (), weight: str | None = None) -> DataFrame:
    """Operator at every grid point: kernel-weighted ridge regression of velocity on state. A row counts ``weight`` times.

    ``cells`` is (cell_id, t, x, v[, keys]). Each task reduces its rows to one moment row per grid point;
    those rows are summed entrywise in Spark and the D x D solves run once per grid point.
    """
    g = np.asarray(grid, dtype=float)
    keys = list(keys)
    cols = [*keys, "t", "x", "v"]
    kinds = dict(cells.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "t_idx int, m array<double>"])
    rows = cells.select(*cols, *([F.col(weight).alias("_w")] if weight else []))
    moments = rows.mapInPandas(_weighted_moments(g, h, dim, keys), schema)
    return _solve_moments(moments, [*keys, "t_idx"], dim, ridge, {i: float(v) for i, v in enumerate(g)})


def _solve_moments(moments: DataFrame, by: list[str], dim: int, ridge: float, at: dict[int, float] | None) -> DataFrame:
    width = 1 + 2 * dim + 2 * dim * dim
    summed = (moments.select(*by, F.posexplode("m").alias("pos", "val")).groupBy(*by, "pos").agg(F.sum("val").alias("val")))
    # ``width`` entries per group
    packed = summed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("e")).select(*by, F.col("e.val").alias("m"))

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series) -> pd.Series:
        return pd.Series([_solve(np.asarray(v, dtype=float), dim, ridge).ravel() for v in m])
    out = packed.where(F.size("m") == width).withColumn("n_rows", F.col("m")[0]).withColumn("j", solve("m")).drop("m")
    if at is not None:
        pts = F.array(*[F.lit(at[i]) for i in sorted(at)])
        out = out.withColumn("t", F.element_at(pts, F.col("t_idx") + 1))
    return out


def cluster_operator(cells: DataFrame, by: str, dim: int, ridge: float = 1e-3, min_rows: int = 5) -> DataFrame:
    """One operator per cluster with at least ``min_rows`` rows, from plain moment sums (by, n_rows, j)."""
    x = [F.col("x").getItem(i) for i in range(dim)]
    v = [F.col("v").getItem(i) for i in range(dim)]
    m = cells.groupBy(by).agg(F.array(
        F.count(F.lit(1)).cast("double"), *[F.sum(c) for c in x], *[F.sum(c) for c in v],
        *[F.sum(a * b) for a in x for b in x], *[F.sum(a * b) for a in x for b in v]).alias("m"))

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series) -> pd.Series:
        return pd.Series([_solve(np.asarray(r, dtype=float), dim, ridge).ravel() for r in m])
    return (m.where(F.col("m")[0] >= min_rows).withColumn("n_rows", F.col("m")[0]).withColumn("j", solve("m")).drop("m"))


def slope_on_grid(cells: DataFrame, state: str, velocity: str, grid: list[float], h: float) -> DataFrame:
    """The one-dimensional case without Python: weighted regression slope at each grid point."""
    pts = F.array(*[F.struct(F.lit(i).alias("t_idx"), F.lit(float(g)).alias("g")) for i, g in enumerate(grid)])
    w = F.exp(-0.5 * F.pow((F.col("g") - F.col("t")) / F.lit(float(h)), F.lit(2.0)))
    e = cells.select("t", F.col(state).alias("x"), F.col(velocity).alias("v"), F.explode(pts).alias("p"))
    e = e.select("x", "v", "t", "p.t_idx", "p.g").withColumn("w", w)
    s = e.groupBy("t_idx").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("v")).alias("sv"),
                               F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("w") * F.col("x") * F.col("v")).alias("sxv"))
    num = F.col("sxv") / F.col("sw") - F.col("sx") * F.col("sv") / (F.col("sw") * F.col("sw"))
    den = F.col("sxx") / F.col("sw") - F.col("sx") * F.col("sx") / (F.col("sw") * F.col("sw"))
    return s.select("t_idx", (num / den).alias("slope"))
