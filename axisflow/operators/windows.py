"""Windows, bins and kernels over the ordering axis.

Row tables are (t, value[, keys]). Results are curves with one row per grid point and key, so window
functions over a curve see at most as many rows as the grid has points.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.scalars import stat
from ..session import cut_lineage
from .kernels import curves, kernel_sums
from .nearest import nearest_rows


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)] if n > 1 else [lo]


def grid_struct(grid: list[float], name: str = "g") -> Column:
    """The grid as an array literal of (t_idx, g)."""
    return F.array(*[F.struct(F.lit(i).alias("t_idx"), F.lit(float(g)).alias(name)) for i, g in enumerate(grid)])


def window_geometry(n: int, overlap: float) -> tuple[float, float]:
    """(width, step) of ``n`` windows covering [0, 1] with the given overlap."""
    width = 1.0 / (1.0 + (n - 1) * (1.0 - overlap))
    return width, width * (1.0 - overlap)


def overlapping_windows(rows: DataFrame, n: int = 100, overlap: float = 0.8) -> DataFrame:
    """Give each row the indices of the windows [i*step, i*step + width] (closed) it falls into.

    A row meets about 1/(1-overlap) windows; the candidates come from arithmetic on t, then the
    closed-interval test decides.
    """
    width, step = window_geometry(n, overlap)
    first = F.greatest(F.ceil((F.col("t") - F.lit(width)) / F.lit(step)) - 1, F.lit(0))
    last = F.least(F.floor(F.col("t") / F.lit(step)) + 1, F.lit(n - 1))
    out = rows.where((F.col("t") >= 0) & (F.col("t") <= 1)).withColumn("t_idx", F.explode(F.sequence(first, last)))
    lo = F.col("t_idx") * F.lit(step)
    return out.where((F.col("t") >= lo) & (F.col("t") <= lo + F.lit(width))).withColumn("t_idx", F.col("t_idx").cast("int"))


def window_mean(rows: DataFrame, n: int = 100, overlap: float = 0.8, weight: str | None = None, min_rows: int = 5,
                keys: list[str] = (), tie: str = "cell_id") -> DataFrame:
    """Mean of ``value`` per window: (keys, t_idx, t, n, mean).

    Windows with fewer than ``min_rows`` rows use the ``min_rows`` rows nearest to their centre instead.
    With ``weight`` the mean is sum(w*v) / (sum(w) + 1e-8).
    """
    keys = list(keys)
    width, step = window_geometry(n, overlap)
    if weight is None:
        agg = F.avg("value")
    else:
        agg = F.sum(F.col(weight) * F.col("value")) / (F.sum(weight) + F.lit(1e-8))
    full = cut_lineage(overlapping_windows(rows, n, overlap).groupBy(*keys, "t_idx").agg(F.count(F.lit(1)).alias("n"), agg.alias("mean")))  # one row per window
    centre = F.lit(step) * F.col("t_idx") + F.lit(width / 2.0)
    idx = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t_idx")
    frame = rows.select(*keys).distinct().select(*keys, idx) if keys else rows.sparkSession.range(n).select(F.col("id").cast("int").alias("t_idx"))
    out = full.where(F.col("n") >= min_rows)
    sparse = frame.join(out, [*keys, "t_idx"], "left_anti").withColumn("_c", centre)
    if not sparse.isEmpty():
        near = nearest_rows(rows, sparse, min_rows, keys, tie).groupBy(*keys, "t_idx").agg(F.count(F.lit(1)).alias("n"), agg.alias("mean"))
        out = out.unionByName(near)
    return out.select(*keys, "t_idx", centre.alias("t"), "n", "mean")


def nearest_m_mean(rows: DataFrame, bins: int = 30, m: int = 20, keys: list[str] = (), tie: str = "cell_id") -> DataFrame:
    """Per grid point on [0, 1], the mean of ``value`` over the ``m`` nearest rows: (keys, t_idx, t, mean)."""
    keys = list(keys)
    near = nearest_rows(rows.select(*keys, "t", "value", tie), _grid_points(rows, linspace(0.0, 1.0, bins), keys), m, keys, tie)
    return near.groupBy(*keys, "t_idx").agg(F.first("_c").alias("t"), F.avg("value").alias("mean"))


def _grid_points(rows: DataFrame, grid: list[float], keys: list[str]) -> DataFrame:
    """(keys, t_idx, _c): the grid for each key."""
    names = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1)
    return names.select(*keys, F.explode(grid_struct(grid, "_c")).alias("_g")).select(*keys, "_g.t_idx", "_g._c")


def peak(curve: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """First argmax of a curve: (keys, t_idx, t, peak)."""
    best = F.max_by(F.struct("t_idx", "t", F.col(value).alias("peak")), F.struct(F.col(value), -F.col("t_idx")))
    return curve.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.t_idx", "b.t", "b.peak")


def knn_adaptive_bandwidth(rows: DataFrame, grid: list[float], k: int = 80, floor: float = 0.005, tie: str = "cell_id") -> DataFrame:
    """Distance from each grid point to the (k+1)-th closest t, at least ``floor``: (t_idx, t, h)."""
    near = nearest_rows(rows.select("t", tie), _grid_points(rows, grid, []), k + 1, [], tie)
    return near.groupBy("t_idx").agg(F.first("_c").alias("t"), F.greatest(F.max("_d"), F.lit(float(floor))).alias("h"))


def kernel_smooth(rows: DataFrame, grid: list[float], h: float | DataFrame, weight: str | None = None, keys: list[str] = (),
                  reach: float | None = None, values: list[str] = ("value",)) -> DataFrame:
    """Gaussian-weighted mean of the value columns and n_eff = (sum w)^2 / sum w^2 per grid point.

    The sums come from :func:`kernels.kernel_sums`. ``h`` is a number or a table (t_idx, h) with a row per grid point;
    ``reach`` (in bandwidths) leaves out farther rows, and points that none is within reach of.
    """
    keys, values = list(keys), list(values)
    if isinstance(h, DataFrame):
        at = {r["t_idx"]: r["h"] for r in h.select("t_idx", "h").collect()}
        grid, names = [grid[i] for i in sorted(at)], sorted(at)
        widths = [[at[i] for i in names]]
    else:
        widths, names = [float(h)], None
    if not grid:
        raise ValueError("the grid is empty")
    sums = kernel_sums(rows, grid, widths, values, weight, keys, reach=reach)
    if reach is not None:
        sums = sums.where(F.col("n") > 0)
    out = curves(sums, grid, keys, values)
    if names is not None and names != list(range(len(names))):
        out = out.withColumn("t_idx", F.element_at(F.array(*[F.lit(i) for i in names]), F.col("t_idx") + 1))
    return out


def gaussian_filter(curve: DataFrame, value: str, n: int, sigma: float, keys: list[str] = (), truncate: float = 4.0,
                    repeat_edge: bool = True) -> DataFrame:
    """Gaussian smoothing of a curve along its index, mirrored at the ends: (keys, t_idx, smooth).

    ``repeat_edge`` mirrors as d c b a | a b c d; without it the end point is not repeated and the kernel
    half-width is that of an odd window of 4 sigma.
    """
    half = int(truncate * sigma + 0.5) if repeat_edge else max(3, int(4 * sigma) | 1) // 2
    weights = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-half, half + 1)]
    total = sum(weights)
    kernel = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w / total).alias("w")) for o, w in zip(range(-half, half + 1), weights)])
    c = curve.select(*keys, "t_idx", F.col(value).alias("_v"), F.explode(kernel).alias("_k"))
    # source row s contributes to every index whose mirrored offset lands on s: spread targets s-o and fold back
    spread = c.select(*keys, "_v", F.col("_k.w").alias("_w"), "t_idx", F.col("_k.o").alias("_o"))
    images = _images("t_idx", n, repeat_edge, half)
    spread = spread.withColumn("_at", F.explode(images)).withColumn("t_to", F.col("_at") - F.col("_o"))
    spread = spread.where((F.col("t_to") >= 0) & (F.col("t_to") < n))
    return (spread.groupBy(*keys, F.col("t_to").cast("int").alias("t_idx")).agg(F.sum(F.col("_v") * F.col("_w")).alias("smooth")))


def _images(idx: str, n: int, repeat_edge: bool, half: int) -> Column:
    """Positions on the extended axis at which an index appears under mirroring."""
    i = F.col(idx)
    period = 2 * n if repeat_edge else max(2 * (n - 1), 1)
    mirror = (F.lit(-1) - i) if repeat_edge else -i
    reps = half // period + 1
    pos = []
    for r in range(-reps, reps + 1):
        pos += [i + F.lit(r * period), mirror + F.lit(r * period)]
    return F.array_distinct(F.array(*pos))


def bin_index(t: str, n: int, upper: bool = True) -> Column:
    """Equal bins on [0, 1]. ``upper``: a value on an edge goes to the upper bin; else to the lower one."""
    scaled = F.col(t) * F.lit(float(n))
    raw = F.floor(scaled) if upper else F.ceil(scaled) - 1
    return F.greatest(F.least(raw, F.lit(n - 1)), F.lit(0)).cast("int")


def _all_bins(rows: DataFrame, n: int, keys: list[str]) -> DataFrame:
    idx = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t_idx")
    if keys:
        return rows.select(*keys).distinct().select(*keys, idx)
    return rows.sparkSession.range(n).select(F.col("id").cast("int").alias("t_idx"))


def bin_mean(rows: DataFrame, n_bins: int, keys: list[str] = ()) -> DataFrame:
    """Mean per bin (lower-edge rule, empty -> 0) and forward difference, last bin backward: (x_mean, dx)."""
    keys = list(keys)
    got = rows.withColumn("t_idx", bin_index("t", n_bins, upper=False)).groupBy(*keys, "t_idx").agg(
        F.avg("value").alias("m"), F.count(F.lit(1)).alias("c"))
    full = _all_bins(rows, n_bins, keys).join(got, [*keys, "t_idx"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    full = full.withColumn("x_mean", F.coalesce("m", F.lit(0.0)))
    w = W.partitionBy(*keys).orderBy("t_idx")
    nx, nc, px, pc = F.lead("x_mean").over(w), F.lead("c").over(w), F.lag("x_mean").over(w), F.lag("c").over(w)
    dx = (F.when(F.col("t_idx") == n_bins - 1, F.when((F.col("c") > 0) & (pc > 0), F.col("x_mean") - px))
          .otherwise(F.when((F.col("c") > 0) & (nc > 0), nx - F.col("x_mean"))))
    return full.select(*keys, "t_idx", "c", "x_mean", F.coalesce(dx, F.lit(0.0)).alias("dx"))


def bin_curve(rows: DataFrame, n_bins: int, keys: list[str] = ()) -> DataFrame:
    """Mean per bin (upper-edge rule), NULL when empty."""
    keys = list(keys)
    got = rows.withColumn("t_idx", bin_index("t", n_bins)).groupBy(*keys, "t_idx").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return _all_bins(rows, n_bins, keys).join(got, [*keys, "t_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bin_mean_std(rows: DataFrame, n_bins: int) -> DataFrame:
    """Mean and population std per bin between min and max of t; every bin half-open, the maximum is left out."""
    s = stat(rows, lo=F.min("t"), hi=F.max("t"))
    width = (s["hi"] - s["lo"]) / F.lit(float(n_bins))
    df = rows.withColumn("t_idx", F.floor(F.try_divide(F.col("t") - s["lo"], width)).cast("int")).where(F.col("t_idx") < n_bins)
    return df.groupBy("t_idx").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))


def window_from_centers(rows: DataFrame, centers: DataFrame, overlap: float, keys: list[str] = ()) -> DataFrame:
    """Mean of ``value`` in windows recovered from their centres (t_idx, t).

    Stride is the median centre difference and the half width stride / (1 - overlap) / 2. Centres are a
    bounded grid: they travel as one array and each row keeps the centres it lies near.
    """
    keys = list(keys)
    points = sorted(tuple(r) for r in centers.select("t_idx", "t").collect())  # a grid
    grid = [float(c) for _, c in points]
    half = 0.5 * float(np.median(np.diff(grid))) / max(1e-9, 1.0 - overlap)
    sums = kernel_sums(rows, grid, [half], keys=keys, box=True).where(F.col("n") > 0)
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("t_idx") + 1)
    return sums.select(*keys, at([i for i, _ in points]).alias("t_idx"), at(grid).alias("t"), (F.col("s_value") / F.col("sw")).alias("mean"), F.col("n").cast("long").alias("n"))


def rolling_mean(rows: DataFrame, size: int, tie: str = "cell_id", block: int = 100_000) -> DataFrame:
    """Centred moving average of ``value`` along the rows sorted by (t, tie); the frame is cut at the ends.

    Rows get their global position, are cut into blocks of positions, and each block also receives the
    few rows beyond its edges, so the frame never needs the whole axis in one task. A block is at least a
    frame wide, so a row goes to three blocks at most.
    """
    before, after, block = size // 2, size - 1 - size // 2, max(block, size)
    pos = ranking.row_positions(rows, "t", tie)
    home = F.floor(F.col("pos") / block)
    near = F.sequence(F.floor(F.greatest(F.col("pos") - after, F.lit(0)) / block), F.floor((F.col("pos") + before) / block))
    halo = pos.withColumn("_home", home).withColumn("_b", F.explode(near))
    w = W.partitionBy("_b").orderBy("pos").rowsBetween(-before, after)
    return halo.withColumn("smooth", F.avg("value").over(w)).where(F.col("_b") == F.col("_home")).drop("_b", "_home")


def fate_bins(rows: DataFrame, n: int, weight: str = "w") -> DataFrame:
    """Weighted mean per equal bin; an empty bin takes the midpoint of its nearest filled neighbours,
    else the one that exists, else 0."""
    got = rows.withColumn("t_idx", bin_index("t", n)).groupBy("t_idx").agg(
        (F.sum(F.col(weight) * F.col("value")) / (F.sum(weight) + F.lit(1e-8))).alias("m"))
    full = _all_bins(rows, n, []).join(got, "t_idx", "left")
    left = F.last("m", ignorenulls=True).over(W.orderBy("t_idx").rowsBetween(W.unboundedPreceding, 0))
    right = F.first("m", ignorenulls=True).over(W.orderBy("t_idx").rowsBetween(0, W.unboundedFollowing))
    full = full.withColumn("_l", left).withColumn("_r", right)
    filled = F.coalesce("m", (F.col("_l") + F.col("_r")) / 2, "_l", "_r", F.lit(0.0))
    return full.select("t_idx", F.col("m").isNull().alias("empty"), filled.alias("mean"))


def bandwidth_shape(curve: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """Contrast C = max - median, FWHM around the peak and L = max / FWHM per key of a curve (t_idx, t, value)."""
    v = F.col(value)
    pk = curve.groupBy(*keys).agg(
        F.max(v).alias("top"), F.percentile(value, 0.5).alias("med"),
        F.max_by("t_idx", F.struct(v, -F.col("t_idx"))).alias("pk"),
        F.min("t_idx").alias("first"), F.max("t_idx").alias("last"))
    c = curve.join(pk, keys) if keys else curve.withColumn("_k", F.lit(1)).join(pk.withColumn("_k", F.lit(1)), "_k")
    low = v <= 0.5 * F.col("top")
    edge = c.groupBy(*keys).agg(
        F.first("top").alias("top"), F.first("med").alias("med"), F.first("pk").alias("pk"),
        F.coalesce(F.max(F.when(low & (F.col("t_idx") < F.col("pk")), F.col("t_idx"))), F.first("first")).alias("li"),
        F.coalesce(F.min(F.when(low & (F.col("t_idx") > F.col("pk")), F.col("t_idx"))), F.first("last")).alias("ri"))
    at = curve.select(*keys, F.col("t_idx"), "t")
    e = (edge.join(at.withColumnsRenamed({"t_idx": "li", "t": "tl"}), [*keys, "li"])
         .join(at.withColumnsRenamed({"t_idx": "ri", "t": "tr"}), [*keys, "ri"]))
    width = F.when(F.col("top") > 0, F.col("tr") - F.col("tl"))
    ratio = F.when(width.isNull() | (width <= 0), 0.0).otherwise(F.col("top") / F.greatest(width, F.lit(1e-6)))
    return e.select(*keys, (F.col("top") - F.col("med")).alias("c"), width.alias("fwhm"), ratio.alias("l"), F.col("top"))


BANDWIDTHS = (0.01, 0.02, 0.03, 0.05, 0.08, 0.10)


def bandwidth_score(rows: DataFrame, grid: list[float], bandwidths: list[float] = BANDWIDTHS, n_boot: int = 20, seed: int = 0,
                    key: str = "cell_id", n_eff_min: float = 30.0, interior: tuple[float, float] = (0.1, 0.9), weight: str | None = None) -> DataFrame:
    """One row per bandwidth: contrast C, sharpness L, reproducibility R over bootstraps, score S = R*C*L and
    the smallest interior n_eff. All bandwidths and replicates come from one pass over the rows."""
    from .nulls import mean_pairwise_correlation
    sums = kernel_sums(rows, grid, list(bandwidths), ["value"], weight, n_boot=n_boot, seed=seed, key=key)
    curve = cut_lineage(curves(sums, grid, ["_h", "_rep"], ["value"]))  # bandwidths x replicates x grid points
    obs = curve.where(F.col("_rep") == -1)
    shape = bandwidth_shape(obs, ["_h"]).select("_h", "c", "l")
    inner = obs.where((F.col("t") >= interior[0]) & (F.col("t") <= interior[1])).groupBy("_h").agg(F.min("n_eff").alias("n_eff_interior_min"))
    r = mean_pairwise_correlation(curve.where(F.col("_rep") >= 0), ["_h"], "_rep", "t_idx", "mean").withColumnRenamed("mean_r", "r")
    out = shape.join(inner, "_h").join(r, "_h", "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    h = F.element_at(F.array(*[F.lit(float(x)) for x in bandwidths]), F.col("_h") + 1)
    out = out.select(h.alias("h"), "c", "l", "n_eff_interior_min", "r")
    return out.withColumn("s", F.col("r") * F.col("c") * F.col("l")).withColumn("valid", F.col("n_eff_interior_min") >= n_eff_min)


def select_bandwidth(scores: DataFrame) -> DataFrame:
    """The bandwidth of highest score among the valid ones, or of all if none is valid."""
    best = F.struct(F.col("valid"), F.col("s"), -F.col("h"))
    return scores.agg(F.max_by(F.struct("h", "s", "valid"), best).alias("b")).select("b.h", "b.s", "b.valid")


def interior_peak(curve: DataFrame, value: str, interior: tuple[float, float] = (0.1, 0.9), n_eff_min: float | None = 50.0,
                  keys: list[str] = ()) -> DataFrame:
    """Highest point inside the interior with enough n_eff; NULLs when none, and a flag if the raw argmax is outside."""
    lo, hi = interior
    ok = (F.col("t") >= lo) & (F.col("t") <= hi)
    if n_eff_min is not None and "n_eff" in curve.columns:
        ok = ok & (F.col("n_eff") >= n_eff_min)
    order = F.struct(F.col(value), -F.col("t_idx"))
    neff = F.col("n_eff") if "n_eff" in curve.columns else F.lit(None).cast("double")
    row = F.struct(F.col("t").alias("t"), F.col(value).alias("value"), F.col("t_idx").alias("idx"), neff.alias("n_eff"))
    a = curve.groupBy(*keys).agg(F.max_by(F.when(ok, row), F.when(ok, order)).alias("p"), F.max_by("t", order).alias("raw"),
                                 F.sum(F.when(ok, 1).otherwise(0)).alias("n_valid"))
    return a.select(*keys, "p.t", "p.value", "p.idx", "n_valid", F.col("p.n_eff").alias("n_eff_at_peak"),
                    ((F.col("raw") < lo) | (F.col("raw") > hi)).alias("boundary_peak"))


def weighted_centre(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean position weighted by the clipped value: (keys, centre); null where no value is positive."""
    e = F.greatest(F.col("value"), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col("t") * e), F.sum(e)).alias("centre"))


def resample_to_grid(curve: DataFrame, grid: list[float], value: str, keys: list[str] = ()) -> DataFrame:
    """Linear interpolation of a curve (t, value) on a grid, extrapolating from the two end points.

    Grid points and curve points meet in one ordered pass per key; the curve is a bounded grid itself.
    """
    keys = list(keys)
    pts = curve.select(*keys, "t", F.col(value).alias("v"), F.lit(None).cast("int").alias("t_idx"))
    names = curve.select(*keys).distinct() if keys else curve.sparkSession.range(1).select(F.lit(1).alias("_one"))
    q = names.select(*keys, F.explode(grid_struct(grid)).alias("p")).select(
        *keys, F.col("p.g").alias("t"), F.lit(None).cast("double").alias("v"), F.col("p.t_idx").alias("t_idx"))
    u = pts.unionByName(q)
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    s = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    back = part.orderBy("t", F.col("t_idx").isNotNull())
    fwd = part.orderBy(F.col("t").desc(), F.col("t_idx").isNotNull())
    run = (W.unboundedPreceding, 0)
    u = (u.withColumn("lo", F.last(s, ignorenulls=True).over(back.rowsBetween(*run)))
         .withColumn("hi", F.last(s, ignorenulls=True).over(fwd.rowsBetween(*run))))
    # two outermost points on each side for extrapolation
    ends = pts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("e"))
    u = u.where(F.col("t_idx").isNotNull())
    u = u.join(ends, keys) if keys else u.withColumn("e", ends.select("e").scalar())
    a = F.when(F.col("lo").isNull(), F.col("e")[0]).when(F.col("hi").isNull(), F.element_at("e", -2)).otherwise(F.col("lo"))
    b = F.when(F.col("lo").isNull(), F.col("e")[1]).when(F.col("hi").isNull(), F.element_at("e", -1)).otherwise(F.col("hi"))
    u = u.withColumn("a", a).withColumn("b", b)
    val = F.when(F.col("a.t") == F.col("b.t"), F.col("a.v")).otherwise(
        F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    return u.select(*keys, "t_idx", "t", val.alias("value"))


def first_crossing(curve: DataFrame, a: str, b: str, keys: list[str] = (), min_gap: float = 0.0) -> DataFrame:
    """First t at which ``a`` falls below ``b`` (linear interpolation between grid points): (keys, t_cross)."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    d = curve.withColumn("_d", F.col(a) - F.col(b))
    w = part.orderBy("t")
    d = d.withColumn("_pd", F.lag("_d").over(w)).withColumn("_pt", F.lag("t").over(w))
    hit = d.where((F.col("_pd") > min_gap) & (F.col("_d") <= 0))
    at = F.col("_pt") + (F.col("t") - F.col("_pt")) * F.col("_pd") / (F.col("_pd") - F.col("_d"))
    return hit.groupBy(*keys).agg(F.min_by(at, "t").alias("t_cross"))
