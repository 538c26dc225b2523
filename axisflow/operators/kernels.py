"""Kernel sums of rows over a grid, for many bandwidths and bootstrap replicates at once.

A task multiplies the kernel matrix of a batch (rows x grid points) by the matrix of replicate counts (rows x
replicates) and adds the products up, so rows are never multiplied by grid points or replicates. What is shuffled is
one row per key, bandwidth, replicate, grid point and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 2_048            # rows of a kernel matrix
HELD = 4_000_000         # sums a task holds before it hands on what it has
PRIME = 2_147_483_647    # modulus of the replicate draws
#: Multipliers of well known congruential generators.
STEPS = (48271, 40692, 69621, 40014)
POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])


def poisson_counts(key: np.ndarray, n_boot: int, seed: int = 0) -> np.ndarray:
    """(rows, n_boot) Poisson(1) counts that depend on the row's key, the replicate and the seed alone."""
    a, b, c, d = STEPS
    h0 = (key.astype(np.int64) % PRIME)[:, None]
    rep = np.arange(1, n_boot + 1, dtype=np.int64)[None, :]
    h1 = (h0 * a + rep * b + seed * c) % PRIME
    h2 = (h1 * h1 + h0) % PRIME
    h3 = (h2 * d + rep) % PRIME
    u = ((h3 * h3 + h1) % PRIME + 0.5) / PRIME
    return np.searchsorted(POISSON, u.ravel(), side="left").reshape(u.shape).astype(float)


def _kernel(t: np.ndarray, grid: np.ndarray, h: np.ndarray, box: bool, reach: float | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Kernel matrix and, where rows are left out, who is within reach."""
    if box:
        near = (t[:, None] >= grid - h) & (t[:, None] <= grid + h)
        return near.astype(float), near
    z = (grid - t[:, None]) / h
    k = np.exp(-0.5 * z * z)
    if reach is None:
        return k, None
    near = np.abs(z) <= reach
    return np.where(near, k, 0.0), near


def _add(acc: np.ndarray, t: np.ndarray, u: np.ndarray, v: np.ndarray, counts: np.ndarray | None, grid, widths, box, reach) -> None:
    """Add a chunk of rows to ``acc[h, rep, (n, sw, sq, values...), grid point]``."""
    known = np.where(np.isnan(v), 0.0, v)
    m = np.ones((len(t), 1)) if counts is None else np.hstack([np.ones((len(t), 1)), counts])
    for i, h in enumerate(widths):
        k, near = _kernel(t, grid, h, box, reach)
        acc[i, :, 0] += m.sum(0)[:, None] if near is None else m.T @ near
        ku = k * u[:, None]
        acc[i, :, 1] += m.T @ ku
        acc[i, :, 2] += m.T @ (ku * ku)
        if counts is None:
            acc[i, 0, 3:] += known.T @ ku
        else:
            for j in range(known.shape[1]):
                acc[i, :, 3 + j] += m.T @ (ku * known[:, j, None])


def kernel_sums(rows: DataFrame, grid: list[float], widths: list, values: list[str] = ("value",), weight: str | None = None, keys: list[str] = (),
                n_boot: int = 0, seed: int = 0, key: str = "cell_id", reach: float | None = None, box: bool = False) -> DataFrame:
    """(keys, _h, _rep, t_idx, n, sw, sq, s_<value>): rows within reach, sums of weights, squared weights and weighted values.

    An entry of ``widths`` is a number or one number per grid point; weights are Gaussian, or 1 within the width with
    ``box``. ``_h`` is the place of the width; replicate -1 holds the data itself, 0 to n_boot-1 count each row a hashed Poisson(1) number of times; the
    draws follow ``key``. Rows without a position are left out; a missing weight counts as 0, a missing value adds nothing.
    """
    keys, values = list(keys), list(values)
    g = np.asarray(grid, float)
    hs = [np.broadcast_to(np.asarray(h, float), g.shape) for h in widths]
    per_key = len(hs) * (n_boot + 1) * (3 + len(values)) * len(g)
    most = max(1, HELD // per_key)
    kinds = dict(rows.dtypes)
    draw = (F.pmod(F.col(key), F.lit(PRIME)) if kinds.get(key) in ("int", "bigint", "smallint", "tinyint") else F.pmod(F.xxhash64(key), F.lit(PRIME))) if n_boot else F.lit(0)
    src = rows.where(F.col("t").isNotNull()).select(
        *keys, F.col("t").cast("double").alias("_t"), (F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))).alias("_u"),
        draw.cast("long").alias("_d"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    cols = [f"_v{i}" for i in range(len(values))]
    names = ["n", "sw", "sq", *[f"s_{v}" for v in values]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        shape = (len(hs), n_boot + 1, len(names), len(g))
        at = np.indices((len(hs), n_boot + 1, len(g)))

        def out() -> Iterator[pd.DataFrame]:
            for k, acc in held.items():
                table = {c: [x] * at[0].size for c, x in zip(keys, k)}
                table |= {"_h": at[0].ravel(), "_rep": at[1].ravel() - 1, "t_idx": at[2].ravel()}
                yield pd.DataFrame(table | {name: acc[:, :, i].ravel() for i, name in enumerate(names)})
            held.clear()

        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for k, some in groups:
                k = tuple(None if x is None or x != x else x for x in (k if isinstance(k, tuple) else (k,)))
                if k not in held:
                    if len(held) >= most:
                        yield from out()
                    held[k] = np.zeros(shape)
                t, u, d, v = some["_t"].to_numpy(), some["_u"].to_numpy(), some["_d"].to_numpy(), some[cols].to_numpy(float)
                for i in range(0, len(t), CHUNK):
                    part = slice(i, i + CHUNK)
                    counts = poisson_counts(d[part], n_boot, seed) if n_boot else None
                    _add(held[k], t[part], u[part], v[part], counts, g, hs, box, reach)
        yield from out()

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "_h int, _rep int, t_idx int", *[f"`{n}` double" for n in names]])
    parts = src.mapInPandas(run, schema)
    return parts.groupBy(*keys, "_h", "_rep", "t_idx").agg(*[F.sum(n).alias(n) for n in names])


def curves(sums: DataFrame, grid: list[float], keys: list[str], values: list[str]) -> DataFrame:
    """Means of the values and n_eff = (sum w)^2 / sum w^2 from kernel sums, with the grid point as t."""
    at = F.element_at(F.array(*[F.lit(float(x)) for x in grid]), F.col("t_idx") + 1)
    names = ["mean"] if list(values) == ["value"] else values
    return sums.select(*keys, "t_idx", at.alias("t"), *[(F.col(f"s_{v}") / F.greatest(F.col("sw"), F.lit(1e-12))).alias(n) for v, n in zip(values, names)],
                       (F.col("sw") * F.col("sw") / F.greatest(F.col("sq"), F.lit(1e-12))).alias("n_eff"))


def bootstrap_curves(rows: DataFrame, grid: list[float], h: float, n_boot: int, weight: str | None = None, keys: list[str] = (), seed: int = 0, key: str = "cell_id") -> DataFrame:
    """(keys, rep, t_idx, t, mean, n_eff) of a kernel curve and its bootstrap replicates; replicate -1 is the curve itself."""
    sums = kernel_sums(rows, grid, [h], ["value"], weight, keys, n_boot, seed, key)
    return curves(sums, grid, [*keys, "_rep"], ["value"]).withColumnRenamed("_rep", "rep")
