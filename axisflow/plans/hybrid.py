"""Operators to refined regulator-to-gene sequence and its modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grn import binned_pullback, grn_modes, refine_grn, tf_mask
from ..operators.windows import bin_mean
from ..session import cut_lineage


def hybrid_grn(operators: DataFrame, decode: DataFrame, encode: DataFrame, genes: DataFrame, tfs: DataFrame, network: DataFrame | None,
               n_bins: int, dim: int, rank: int, expression: DataFrame | None = None, n_steps: int = 10, **penalties) -> dict:
    """Panel -> mask -> bin means -> pullback -> refinement -> modes.

    ``expression`` (t, gene, value) adds the binned means and differences for the local-dynamics penalty.
    """
    mask = None
    if network is not None:
        mask = tf_mask(genes.select(F.col("gene").cast("string").alias("gene")), tfs.select(F.col("tf").cast("string").alias("tf")),
                       network.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")))
    dec = decode.join(genes.select("gene"), "gene", "left_semi").withColumn("gene", F.col("gene").cast("string"))
    enc = encode.withColumn("tf", F.col("tf").cast("string"))
    # with L1 alone the entries outside the mask cannot influence the others, so only masked pairs are formed
    closed = not any(penalties.get(p) for p in ("lam_temporal", "lam_local", "lam_prior"))
    j = cut_lineage(binned_pullback(operators, dec, enc, n_bins, dim, tfs.select(F.col("tf").cast("string").alias("tf")), mask if closed else None))
    x_tf = dx = None
    if expression is not None:
        m = bin_mean(expression, n_bins, ["gene"]).withColumn("gene", F.col("gene").cast("string"))
        dx = m.select(F.col("t_idx").alias("bin"), "gene", "dx")
        x_tf = m.select(F.col("t_idx").alias("bin"), F.col("gene").alias("tf"), F.col("x_mean").alias("x"))
    refined = cut_lineage(refine_grn(j, n_steps, mask=mask, x_tf=x_tf, dx=dx, **penalties))
    return {"pulled": j, "refined": refined, "modes": grn_modes(refined, n_bins, rank)}
