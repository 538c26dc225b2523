"""Branches, stability regimes and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stat

# Regime names and default thresholds.
REGIMES = ("stable", "plastic", "unstable", "deeply_stable")
TAU, EPS, PLASTICITY, DEEP = 0.1, 0.05, 0.3, -1.0
METRICS = ("lambda_max", "lambda_min", "plasticity", "stable_dim")


def assign_branches(probs: DataFrame, threshold: float = 0.5, key: str = "cell_id") -> DataFrame:
    """Most probable branch per row if its probability reaches the threshold."""
    best = probs.groupBy(key).agg(F.min(F.struct(-F.col("prob"), "branch")).alias("b"))
    return best.select(key, F.col("b.branch").alias("branch"), (-F.col("b.col1")).alias("prob")).where(F.col("prob") >= threshold)


def branches_from_masks(cells: DataFrame, masks: list[str], key: str = "cell_id") -> DataFrame:
    """Overlapping membership from boolean columns: (key, branch)."""
    long = cells.unpivot([key], masks, "branch", "member")
    return long.where(F.col("member")).select(key, "branch")


def branches_from_labels(cells: DataFrame, label: str, key: str = "cell_id") -> DataFrame:
    return cells.where(F.col(label).isNotNull()).select(key, F.col(label).alias("branch"))


def min_branch_size(members: DataFrame, minimum: int = 50) -> tuple[DataFrame, DataFrame]:
    """(members of large branches, table of dropped branches)."""
    n = members.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))
    return members.join(n.where(F.col("n") >= minimum), "branch", "left_semi"), n.where(F.col("n") < minimum)


def dominant_branch_weight(probs: DataFrame, key: str = "cell_id") -> DataFrame:
    """The branch of highest mean probability gives the row weights: (key, branch, w)."""
    top = probs.groupBy("branch").agg(F.avg("prob").alias("m")).agg(F.min(F.struct(-F.col("m"), "branch")).alias("b")).select("b.branch").scalar()
    return probs.where(F.col("branch") == top).select(key, "branch", F.col("prob").alias("w"))


def classify_regime(metrics: DataFrame, tau: float = TAU, eps: float = EPS, plasticity: float = PLASTICITY, deep: float = DEEP) -> DataFrame:
    """unstable, then deeply_stable, then plastic, else stable."""
    regime = (F.when(F.col("lambda_max") > tau, "unstable").when(F.col("lambda_min") < deep, "deeply_stable")
              .when((F.abs("lambda_max") < eps) & (F.col("plasticity") > plasticity), "plastic").otherwise("stable"))
    return metrics.withColumn("regime", regime)


def regime_confidence(classified: DataFrame, tau: float = TAU, plasticity: float = PLASTICITY, deep: float = DEEP) -> DataFrame:
    """Distance to the deciding boundary, relative to it and clipped to [0, 1]."""
    raw = (F.when(F.col("regime") == "unstable", (F.col("lambda_max") - tau) / tau)
           .when(F.col("regime") == "deeply_stable", (deep - F.col("lambda_min")) / abs(deep))
           .when(F.col("regime") == "plastic", (F.col("plasticity") - plasticity) / (1 - plasticity))
           .otherwise((tau - F.col("lambda_max")) / tau))
    return classified.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def regime_stats(classified: DataFrame) -> DataFrame:
    """Count, share, mean and population std of the four metrics per regime."""
    total = classified.agg(F.count(F.lit(1)).alias("n")).scalar()
    aggs = [a for m in METRICS for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return (classified.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), *aggs).withColumn("fraction", F.col("n") / total))


def compare_regimes(classified: DataFrame, condition: str, celltype: str | None = None) -> DataFrame:
    """Regime counts and fractions by condition, and by cell type within condition, zero-filled over the four regimes.

    Rows of the overall comparison have a NULL cell type; both levels come from one grouping-sets pass.
    """
    counts = [F.sum(F.when(F.col("regime") == r, 1).otherwise(0)).alias(r) for r in REGIMES]
    if celltype is None:
        g = classified.groupBy(condition).agg(F.count(F.lit(1)).alias("total"), *counts)
    else:
        g = (classified.groupingSets([[condition], [celltype, condition]], celltype, condition)
             .agg(F.count(F.lit(1)).alias("total"), *counts))
    return g.withColumns({f"{r}_fraction": F.col(r) / F.col("total") for r in REGIMES})


def regime_diversity(classified: DataFrame, celltype: str) -> DataFrame:
    """Rows, regimes present and entropy (base 2) of the regime distribution per cell type."""
    c = classified.groupBy(celltype, "regime").agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(celltype).agg(F.sum("n").alias("n_rows"))
    p = F.col("n") / F.col("n_rows")
    return (c.join(t, celltype).groupBy(celltype).agg(
        F.first("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_regimes"), F.sum(-p * F.log2(p + F.lit(1e-10))).alias("entropy"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("regime", "n")))).alias("distribution")))


def progenitor_masks(fates: DataFrame, branches: list[str], progenitor: str = "Progenitor", key: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """(membership: progenitor rows join every branch, sizes and shares per branch)."""
    every = F.array(*[F.lit(b) for b in branches])
    hit = F.when(F.col("fate") == progenitor, every).when(F.col("fate").isin(branches), F.array("fate")).otherwise(F.array().cast("array<string>"))
    members = fates.select(key, F.explode(hit).alias("branch"))
    total = fates.agg(F.count(F.lit(1)).alias("n")).scalar()
    sizes = members.groupBy("branch").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)
    return members, sizes


def crosstab(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Row-normalised cross tabulation in long form: (rows, cols, n, share)."""
    c = df.groupBy(rows, cols).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(rows).agg(F.sum("n").alias("_t"))
    return c.join(t, rows).select(rows, cols, "n", (F.col("n") / F.col("_t")).alias("share"))


def scale_axis(cells: DataFrame, column: str = "t") -> DataFrame:
    """Axis to [0, 1]; missing axis values become 0.5 when no row has one."""
    s = stat(cells, lo=F.min(column), hi=F.max(column))
    t = F.when(s["lo"].isNull(), F.lit(0.5)).otherwise((F.col(column) - s["lo"]) / (s["hi"] - s["lo"] + F.lit(1e-8)))
    return cells.withColumn(column, t)
