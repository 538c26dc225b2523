"""From a direction field to ranked features, for all branches in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.vectors import dot_fixed
from ..operators.field import local_linear_operator
from ..operators.spectra import operator_spectrum, sign_align


def drift_by_branch(cells: DataFrame, loadings: DataFrame, dim: int, grid: list[float], h: float, ridge: float = 1e-3, top: int = 50,
                    thr: float = 0.0) -> dict[str, DataFrame]:
    """``cells`` (cell_id, branch, t, x, v) -> operators, sensitivity curve and ranked features keyed by branch.

    The vectors of all branches and grid points (branches x grid rows) are packed once and every feature row
    walks them, so the feature table is read in place.
    """
    ops = local_linear_operator(cells, grid, h, dim, ridge, keys=["branch"])
    sp = operator_spectrum(ops, dim)
    aligned = sign_align(sp.select("branch", "t_idx", "t", "lam", "v"), ["branch"])
    sens = aligned.where(F.col("lam") > thr)
    packed = sens.agg(F.collect_list(F.struct("branch", "t_idx", "v")).alias("p")).scalar()
    n = sens.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))
    e = loadings.withColumn("_p", packed).select("feature", "w", F.explode("_p").alias("q"))
    s = e.groupBy(F.col("q.branch").alias("branch"), "feature").agg(F.sum(F.abs(dot_fixed("w", "q.v", dim))).alias("s")).join(n, "branch")
    feats = ranking.top_n(s.select("branch", "feature", (F.col("s") / F.col("n")).alias("mean_score")), top,
                          [F.col("mean_score").desc(), F.col("feature")], ["branch"])
    return {"operators": sp, "curve": aligned.select("branch", "t_idx", "t", "lam"), "features": feats}
