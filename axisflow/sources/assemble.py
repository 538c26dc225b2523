"""Assembly of the analysis tables from already loaded DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.scalars import stat
from ..functions.vectors import sum_vectors
from ..schema import require


def stratified_sample(df: DataFrame, by: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """A fixed quota of rows per stratum, max(1, n // strata), chosen by hashed key.

    The rank is limited map-side, so no stratum is gathered whole.
    """
    from ..functions.ranking import top_n
    strata = df.agg(F.count_distinct(by)).first()[0]
    quota = max(1, n // max(1, strata))
    return top_n(df, quota, [hashing.uniform(key, seed=seed), F.col(key)], [by], "_rk").drop("_rk")


def rescale_axis(cells: DataFrame, column: str = "t") -> DataFrame:
    """Min-max the axis to [0, 1]; a constant axis becomes 0."""
    s = stat(cells, lo=F.min(column), hi=F.max(column))
    span = s["hi"] - s["lo"]
    return cells.withColumn(column, F.when(span > 0, (F.col(column) - s["lo"]) / span).otherwise(F.lit(0.0)))


def latent_from_tables(cells: DataFrame, latent: DataFrame, velocity: DataFrame | None = None,
                       rep: str | None = None, rescale: bool = False, tol: float = 1e-6) -> DataFrame:
    """(cell_id, t, x[, v]) in one table. The axis must lie in [0, 1] unless ``rescale`` is set;
    a velocity whose width differs from the latent width becomes NULL."""
    require(cells, "cell_id", "t")
    require(latent, "cell_id", "x")
    if rep is not None:
        latent = require(latent, "rep").where(F.col("rep") == rep)
    if rescale:
        cells = rescale_axis(cells)
    else:
        lo, hi = cells.agg(F.min("t"), F.max("t")).first()
        if lo is not None and (lo < -tol or hi > 1 + tol):
            raise ValueError(f"axis spans [{lo}, {hi}], expected [0, 1]; pass rescale=True")
    out = cells.select("cell_id", "t").join(latent.select("cell_id", "x"), "cell_id")
    if velocity is not None:
        out = out.join(velocity.select("cell_id", "v"), "cell_id", "left")
        out = out.withColumn("v", F.when(F.size("v") == F.size("x"), F.col("v")))
    return out


def project_velocity(velocity: DataFrame, loadings: DataFrame, dim: int) -> DataFrame:
    """Feature-space velocity (cell_id, feature, value) times loadings (feature, w) -> (cell_id, v)."""
    joined = velocity.join(loadings.select("feature", "w"), "feature")
    return joined.groupBy("cell_id").agg(sum_vectors("w", dim, F.col("value")).alias("v"))


def select_panel(expr: DataFrame, panel: DataFrame, tfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expression restricted to the panel with an ``is_tf`` flag, panel features not present)."""
    present = expr.select("feature").distinct()
    missing = panel.select("feature").distinct().join(present, "feature", "left_anti")
    flags = panel.select("feature").distinct().join(
        tfs.select("feature").distinct().withColumn("is_tf", F.lit(True)), "feature", "left"
    ).withColumn("is_tf", F.coalesce("is_tf", F.lit(False)))
    return expr.join(flags, "feature"), missing


def align_observations(first: DataFrame, second: DataFrame, key: str = "cell_id", fill: float = 0.0) -> DataFrame:
    """Reindex the second table onto the rows of the first; numeric gaps get ``fill``."""
    others = [c for c in second.columns if c != key]
    out = first.join(second, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in others
                            if dict(second.dtypes)[c] in ("double", "float", "int", "bigint")})


def fate_probabilities(df: DataFrame, candidates: list[str], names: list[str], key: str = "cell_id") -> DataFrame:
    """Long (key, branch, prob) from the first probability array present under one of the names."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise KeyError(f"none of {candidates} in {df.columns}")
    labels = F.array(*[F.lit(n) for n in names])
    return (df.select(key, F.posexplode(found).alias("i", "prob"))
            .select(key, F.element_at(labels, F.col("i") + 1).alias("branch"), F.col("prob").cast("double").alias("prob")))
