"""The null model that repeats the factorisation on a shuffled grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators.nulls import null_summary, pair_coordination, replicates
from ..operators.spectra import nmf_start, nmf_weights, semi_nmf_models
from ..session import cut_lineage

METRICS = ["sequential_frac", "concurrent_frac", "mean_abs_corr"]


def shuffled_coordination(rows: DataFrame, rank: int, width: int, n_rep: int, iters: int = 500, seed: int = 0) -> DataFrame:
    """(rep, metrics) of the factorisation of the rows (t_idx, m) and, for rep 0 to n_rep-1, of permutations of their order.

    Replicate -1 is the order itself. A permutation gives every row another index, and with it other first weights and
    another place of its activations; the rows themselves stay, so all factorisations share every pass over them.
    """
    rows = cut_lineage(rows.select("t_idx", "m"))
    names = replicates(rows.select("t_idx"), n_rep)  # grid points x replicates
    by_rep = W.partitionBy("rep")
    to = names.withColumn("_p", F.row_number().over(by_rep.orderBy(hashing.uniform("t_idx", "rep", seed=seed), "t_idx")))
    index = names.withColumn("_p", F.row_number().over(by_rep.orderBy("t_idx"))).withColumnRenamed("t_idx", "new")
    moved = to.join(index, ["rep", "_p"]).groupBy("t_idx").agg(F.sort_array(F.collect_list(F.struct("rep", "new"))).alias("_to"))
    data = cut_lineage(rows.join(moved, "t_idx") if n_rep else rows.withColumn("_to", F.array().cast("array<struct<rep:int,new:int>>")))
    at = [F.col("t_idx"), *[F.col("_to")[r]["new"] for r in range(n_rep)]]
    hs, _ = semi_nmf_models(data, [nmf_start(x, rank, seed) for x in at], rank, width, iters)
    maps = np.concatenate([nmf_weights(h) for h in hs], axis=1)

    @F.pandas_udf("array<double>")
    def weights(m: pd.Series) -> pd.Series:
        return pd.Series(list(np.maximum(np.stack(m.to_numpy()) @ maps, 0.0)))
    cells = F.array(*[F.struct(F.lit(r - 1).alias("rep"), x.cast("int").alias("t_idx"), F.lit(k).alias("k"), F.col("_w")[r * rank + k].alias("a"))
                      for r, x in enumerate(at) for k in range(rank)])
    act = data.withColumn("_w", weights("m")).select(F.explode(cells).alias("_c")).select("_c.*")
    return pair_coordination(act, ["rep"])


def shuffle_null(rows: DataFrame, rank: int, width: int, n_rep: int = 100, iters: int = 500, seed: int = 0) -> DataFrame:
    """Permute the grid order (t_idx, m), refit and summarise against the observation.

    The factorisation hardly depends on row order, so this null is kept for comparison; circular shifts and
    block permutations are the informative ones.
    """
    both = cut_lineage(shuffled_coordination(rows, rank, width, n_rep, iters, seed))
    return null_summary(both.where(F.col("rep") >= 0).drop("rep"), both.where(F.col("rep") < 0).drop("rep"), METRICS)
