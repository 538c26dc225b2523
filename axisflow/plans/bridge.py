"""Bridges between a source population and one or many target populations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.field import local_linear_operator
from ..operators.spectra import operator_spectrum
from ..operators.transport import bridge_targets, moment_pairs
from ..operators.windows import linspace


def bridge_populations(cells: DataFrame, label: str, source: str, targets: list[str]) -> DataFrame:
    """One row per (target, side, cell): every target label against the shared source, keyed so that all bridges run as one job.

    Labels without rows are left out; an empty source is an error. Source rows are repeated once per target label.
    """
    src = cells.where(F.col(label) == source)
    if src.isEmpty():
        raise ValueError(f"no rows with {label} = {source!r}")
    tgt = cells.where(F.col(label).isin(targets)).select(F.col(label).alias("target"), F.lit("target").alias("side"), "cell_id")
    found = tgt.agg(F.collect_set("target").alias("t")).scalar()  # at most len(targets) names
    return src.select(F.explode(found).alias("target"), F.lit("source").alias("side"), "cell_id").unionByName(tgt)


def bridge_operators(pairs: DataFrame, x: DataFrame, y: DataFrame, dim: int, n_t: int = 30, h: float = 0.05, ridge: float = 1e-3,
                     keys: list[str] = ()) -> DataFrame:
    """Local operators and spectra along both directions on ``n_t`` points of [0.03, 0.97].

    ``pairs`` (i, j[, keys]) are coupled rows; the regression table is built per t value and the fit at a grid
    point weighs its neighbours by the kernel. State and velocity at a t are linear in the coupled rows and the fit takes their
    second moments only, so the table is built from the few weighted pairs that have those of all pairs.
    """
    grid = linspace(0.03, 0.97, n_t)
    few, x0, x1 = moment_pairs(pairs, x, y, dim, list(keys))
    table = bridge_targets(few, x0, x1, grid)
    ops = local_linear_operator(table, grid, h, dim, ridge, keys=[*keys, "direction"], weight="weight")
    return operator_spectrum(ops, dim)
