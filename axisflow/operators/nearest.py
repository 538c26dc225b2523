"""The rows nearest to points of the axis, found through counts before any row is multiplied.

A histogram of the axis tells how far the m-th nearest row of a point can be at most. Only rows within that radius meet
the point, through an equi-join on cells of the axis, so about m rows are looked at per point and not all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking
from ..session import cut_lineage

BINS = 4_096           # of the axis, and of the distances around a point
MOST_CELLS = 1_024     # of the axis in which rows meet points
CROWDED = 64           # times m: more rows within the radius, and the radius is narrowed by another count
LEVELS = 4             # counts at most; equal positions cannot be told apart by any


def _bin(t: Column, lo: float, hi: float, n: int) -> Column:
    if not hi > lo:
        return F.lit(0)
    return F.greatest(F.least(F.floor((t - F.lit(lo)) / F.lit((hi - lo) / n)), F.lit(n - 1)), F.lit(0)).cast("int")


def _radii(m: int):
    """Rows (keys, bins, points) to one row per point with its radius and the rows that can lie within it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                lo = np.array([b["lo"] for b in row.bins])
                hi = np.array([b["hi"] for b in row.bins])
                n = np.array([b["n"] for b in row.bins])
                idx, cs = [p["t_idx"] for p in row.points], np.array([p["_c"] for p in row.points])
                far = np.maximum(np.abs(lo - cs[:, None]), np.abs(hi - cs[:, None]))
                order = far.argsort(axis=1)
                upto = n[order].cumsum(axis=1)
                last = np.minimum((upto < m).sum(axis=1), len(n) - 1)
                r = np.take_along_axis(far, order, 1)[np.arange(len(cs)), last]
                inside = ((lo <= (cs + r)[:, None]) & (hi >= (cs - r)[:, None])) @ n
                keys = {c: [getattr(row, c)] * len(cs) for c in pdf.columns[:-2]}
                yield pd.DataFrame({**keys, "t_idx": idx, "_c": cs, "_r": r, "_near": inside})
    return run


def within(rows: DataFrame, points: DataFrame, keys: list[str], lo: float, hi: float, cells: int) -> DataFrame:
    """Rows beside each point (keys, t_idx, _c, _r) they lie within the radius of, with ``_r`` and their distance ``_d``."""
    first, last = _bin(F.col("_c") - F.col("_r"), lo, hi, cells), _bin(F.col("_c") + F.col("_r"), lo, hi, cells)
    placed = points.select(*keys, "t_idx", "_c", "_r", F.explode(F.sequence(first, last)).alias("_cell"))
    near = rows.where(F.col("t").isNotNull()).withColumn("_cell", _bin(F.col("t"), lo, hi, cells)).join(placed, [*keys, "_cell"]).withColumn("_d", F.abs(F.col("t") - F.col("_c")))
    return near.where(F.col("_d") <= F.col("_r")).drop("_cell")


def bounded_points(rows: DataFrame, points: DataFrame, m: int, keys: list[str]) -> tuple[DataFrame, float, float, int]:
    """Points with a radius ``_r`` that holds their ``m`` nearest rows, the ends of the axis and the number of cells to meet in."""
    known = rows.where(F.col("t").isNotNull())
    ends = known.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not ends["n"]:
        return points.withColumn("_r", F.lit(0.0)), 0.0, 0.0, 1
    lo, hi = float(ends["lo"]), float(ends["hi"])
    hist = known.groupBy(*keys, _bin(F.col("t"), lo, hi, BINS).alias("_bin")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
    bins = hist.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "n")).alias("bins"))  # at most BINS of them
    asked = points.groupBy(*keys).agg(F.collect_list(F.struct("t_idx", F.col("_c").cast("double").alias("_c"))).alias("points"))  # the points of one grid
    both = bins.join(asked, keys) if keys else bins.withColumn("points", asked.scalar())
    kinds = dict(rows.dtypes)
    index = dict(points.dtypes)["t_idx"]
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"t_idx {index}, _c double, _r double, _near long"])
    found = cut_lineage(both.where(F.col("points").isNotNull()).select(*keys, "bins", "points").mapInPandas(_radii(m), schema))
    size = found.agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.max("_near"), F.lit(0)).alias("near"), F.count_distinct("t_idx").alias("grid")).first()
    groups = max(1, size["points"] // max(1, size["grid"]))
    cells = int(min(MOST_CELLS, max(1, ends["n"] // (groups * m))))
    for _ in range(LEVELS - 1):
        if size["near"] <= CROWDED * max(m, 64):
            break
        found = cut_lineage(_narrowed(known, found, m, keys, lo, hi, cells))
        before, size = size["near"], found.agg(F.coalesce(F.max("_near"), F.lit(0)).alias("near")).first()
        if size["near"] >= before:
            break
    return found, lo, hi, cells


def _narrowed(rows: DataFrame, points: DataFrame, m: int, keys: list[str], lo: float, hi: float, cells: int) -> DataFrame:
    """The crowded points again, with radii from counts of the distances inside the old ones."""
    crowded = points.where(F.col("_near") > CROWDED * max(m, 64))
    near = within(rows, crowded, keys, lo, hi, cells)
    step = F.least(F.floor(F.try_divide(F.col("_d") * F.lit(float(BINS)), F.col("_r"))), F.lit(BINS - 1))
    counts = near.groupBy(*keys, "t_idx", "_c", F.coalesce(step, F.lit(0)).alias("_step")).agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("far"))
    steps = F.sort_array(F.collect_list(F.struct("_step", "n", "far")))  # at most BINS of them
    packed = counts.groupBy(*keys, "t_idx", "_c").agg(steps.alias("s"))
    upto = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("r")),
                       lambda a, x: F.when(a["n"] >= m, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), F.greatest(a["r"], x["far"]).alias("r"))))
    some = packed.withColumn("_u", upto).select(*keys, "t_idx", "_c", F.col("_u.r").alias("_r"), F.col("_u.n").alias("_near"))
    return points.where(F.col("_near") <= CROWDED * max(m, 64)).unionByName(some)


def nearest_rows(rows: DataFrame, points: DataFrame, m: int, keys: list[str] = (), tie: str = "cell_id") -> DataFrame:
    """The ``m`` rows nearest in t to each point (keys, t_idx, _c), with ``_d`` and their rank ``_rk``; smaller ``tie`` wins.

    Ranks are limited in each map task, so what is shuffled is at most m rows per point and task.
    """
    keys = list(keys)
    found, lo, hi, cells = bounded_points(rows, points, m, keys)
    near = within(rows, found.select(*keys, "t_idx", "_c", "_r"), keys, lo, hi, cells)
    return ranking.top_n(near.drop("_r"), m, [F.col("_d"), F.col(tie)], [*keys, "t_idx"], "_rk")
