"""Feature spaces, clustering and agreement of label columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gram import summed
from ..session import cut_lineage
from .prep import standardize
from .regimes import METRICS


def operator_features(metrics: DataFrame) -> DataFrame:
    """The four metrics standardised, as (cell_id, x)."""
    return standardize(metrics, list(METRICS)).select("cell_id", F.array(*METRICS).alias("x"))


def standardize_vectors(df: DataFrame, dim: int, col: str = "x") -> DataFrame:
    """z-score every component of an array column (population std; constant components become 0)."""
    c = F.col(col)
    s = df.agg(F.array(*[F.struct(F.avg(c[i]).alias("m"), F.stddev_pop(c[i]).alias("s")) for i in range(dim)]).alias("s")).scalar()
    z = F.zip_with(c, F.col("_st"), lambda v, p: F.when(p["s"] > 0, (v - p["m"]) / p["s"]).otherwise(F.lit(0.0)))
    return df.withColumn("_st", s).withColumn(col, z).drop("_st")


def joint_space(expr: DataFrame, oper: DataFrame, alpha: float, dim_e: int, dim_o: int) -> DataFrame:
    """(1 - alpha) z(expr) + alpha z(oper): elementwise for equal width, else weighted blocks side by side."""
    a = standardize_vectors(expr.select("cell_id", "x"), dim_e).withColumnRenamed("x", "a")
    b = standardize_vectors(oper.select("cell_id", "x"), dim_o).withColumnRenamed("x", "b")
    wa, wb = F.lit(1.0 - alpha), F.lit(float(alpha))
    j = a.join(b, "cell_id")
    if dim_e == dim_o:
        return j.select("cell_id", F.zip_with("a", "b", lambda p, q: wa * p + wb * q).alias("x"))
    return j.select("cell_id", F.concat(F.transform("a", lambda p: wa * p), F.transform("b", lambda q: wb * q)).alias("x"))


def kmeans(features: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Cluster labels from MLlib KMeans on (cell_id, x)."""
    v = features.select("cell_id", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=30).fit(v).transform(v).select("cell_id", F.col("prediction").alias("cluster"))


def label_propagation(graph: DataFrame, rounds: int | None = None, log: list | None = None) -> DataFrame:
    """Community labels on a weighted graph (src, dst, w): heaviest neighbour label wins, smaller label on ties.

    A row also votes for its own label with half of its mean edge weight, which damps flip-flops. It ends when no label
    changes, or when labels flip-flop all the same and those of an earlier round return, or after ``rounds``. ``log``
    takes a hash of the labels after each round.
    """
    g = cut_lineage(graph.where(F.col("src") != F.col("dst")).select("src", "dst", "w"))
    own = g.groupBy("src").agg((F.avg("w") / 2).alias("w"))
    lab = g.select(F.col("src").alias("cell_id")).union(g.select("dst")).distinct().withColumn("cluster", F.col("cell_id"))
    seen = log if log is not None else []
    while rounds is None or len(seen) < rounds:
        votes = (g.join(lab.withColumnRenamed("cell_id", "dst"), "dst").select("src", "cluster", "w")
                 .union(own.join(lab.withColumnRenamed("cell_id", "src"), "src").select("src", "cluster", "w")))
        tally = votes.groupBy("src", "cluster").agg(F.sum("w").alias("w"))
        lab = cut_lineage(tally.groupBy("src").agg(F.min(F.struct(-F.col("w"), "cluster")).alias("b")).select(F.col("src").alias("cell_id"), F.col("b.cluster").alias("cluster")))
        state = lab.agg(*[F.coalesce(F.bit_xor(F.xxhash64("cell_id", "cluster", F.lit(i))), F.lit(0)) for i in range(2)]).first()
        seen.append(tuple(state))
        if seen[-1] in seen[:-1]:
            break
    return lab


def ari_nmi(df: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic), per key.

    Both need only the sums of n(n-1)/2 and n ln n over the contingency table and its two margins, so the
    counted table is rolled up by grouping sets in one pass and never joined with itself.
    """
    keys = list(keys)
    c = df.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    g = c.groupingSets([[*keys, "_a", "_b"], [*keys, "_a"], [*keys, "_b"]], *keys, "_a", "_b").agg(F.grouping_id(*keys, "_a", "_b").alias("g"), F.sum("n").alias("n"))
    level = {"ab": 0, "a": 1, "b": 2}
    at = lambda name, e: F.sum(F.when(F.col("g") == level[name], e))
    pairs, nln = F.col("n") * (F.col("n") - 1) / 2, F.col("n") * F.log("n")
    s = g.groupBy(*keys).agg(at("ab", F.col("n")).alias("t"), *[at(k, pairs).alias(f"p_{k}") for k in level], *[at(k, nln).alias(f"e_{k}") for k in level])
    t = F.col("t")
    h = {k: F.log(t) - F.col(f"e_{k}") / t for k in level}
    expected, top = F.col("p_a") * F.col("p_b") / (t * (t - 1) / 2), (F.col("p_a") + F.col("p_b")) / 2
    mi = F.greatest(h["a"] + h["b"] - h["ab"], F.lit(0.0))
    return s.select(*keys, F.when(top == expected, 1.0).otherwise((F.col("p_ab") - expected) / (top - expected)).alias("ari"),
                    F.when(h["a"] + h["b"] <= 0, 1.0).otherwise(mi / ((h["a"] + h["b"]) / 2)).alias("nmi"))


BLOCKS, BLOCK_ROWS, BLOCK_BYTES = 16, 512, 8 << 20  # of a block of rows: so many at least, its least rows and its most bytes
CHUNK = 256                                         # rows of a block that are compared at once


def silhouette(df: DataFrame, label: str, dim: int, block_rows: int | None = None) -> DataFrame:
    """Mean Euclidean silhouette over rows (cell_id, x, label), one row per call: (silhouette, n).

    Blocks of rows meet blocks of rows, a pair of blocks in one group; a group returns one distance sum per row and cluster,
    so pairs are never written out. Blocks grow with the rows, so that a row is sent to few of them. Singleton clusters score 0.
    """
    n = df.count()
    blocks = max(1, -(-n // (block_rows or max(1, min(max(BLOCK_ROWS, n // BLOCKS), BLOCK_BYTES // (8 * dim))))))
    dealt = cut_lineage(df.select("cell_id", "x", F.col(label).cast("string").alias("l"), F.pmod(F.xxhash64("cell_id"), F.lit(blocks)).cast("int").alias("b")))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.select(F.col("b").alias("qb"), every.alias("rb"), F.col("cell_id").alias("cell_id"), F.col("x").alias("x"), F.col("l").alias("own"))
    right = dealt.select(every.alias("qb"), F.col("b").alias("rb"), F.col("x").alias("x"), F.col("l").alias("l"))

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"cell_id": [], "own": [], "l": [], "s": []})
        a, b = np.stack(q["x"].to_numpy()), np.stack(r["x"].to_numpy())
        idx, names = pd.factorize(r["l"].to_numpy(), use_na_sentinel=False)
        one, bb, out = np.eye(len(names))[idx], (b * b).sum(1), []
        for at in range(0, len(a), CHUNK):
            x = a[at:at + CHUNK]
            out.append(np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ b.T + bb[None, :], 0.0)) @ one)
        return pd.DataFrame({"cell_id": np.repeat(q["cell_id"].to_numpy(), len(names)), "own": np.repeat(q["own"].to_numpy(), len(names)),
                             "l": np.tile(names, len(q)), "s": np.concatenate(out).ravel()})
    key_t = dict(df.dtypes)["cell_id"]
    sums = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(run, f"cell_id {key_t}, own string, l string, s double")
    per = sums.groupBy("cell_id", "own", "l").agg(F.sum("s").alias("s"))
    size = df.groupBy(F.col(label).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("m"))
    per = per.join(size, "l")
    a = F.max(F.when(F.col("l") == F.col("own"), F.when(F.col("m") > 1, F.col("s") / (F.col("m") - 1))))
    b = F.min(F.when(F.col("l") != F.col("own"), F.col("s") / F.col("m")))
    row = per.groupBy("cell_id").agg(a.alias("a"), b.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return row.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def clustering_report(df: DataFrame, truth: str, labels: list[str], dim: int) -> DataFrame:
    """ARI, NMI, silhouette and cluster count for several label columns."""
    out = None
    for c in labels:
        row = ari_nmi(df, truth, c).withColumn("labels", F.lit(c))
        row = row.withColumn("silhouette", silhouette(df, c, dim).select("silhouette").scalar())
        row = row.withColumn("n_clusters", df.agg(F.count_distinct(c).alias("n")).scalar())
        out = row if out is None else out.unionByName(row)
    return out


SAMPLE = 2_000  # rows, drawn by a hash of their id, that the first centres are chosen from


def _first_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each further centre is drawn in proportion to the squared distance to those before."""
    at = [int(rng.integers(len(x)))]
    d = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < min(k, len(x)):
        at.append(int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(x))))
        d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def _nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2.0 * x @ c.T).argmin(1)


def kmeans_models(df: DataFrame, spaces: list, k: int, iters: int = 30, tol: float = 1e-4, seed: int = 0) -> tuple[list[np.ndarray], int]:
    """Centres of one k-means per entry of ``spaces``, functions from a batch (a, b) to its points; all share every pass.

    ``df`` is (cell_id, a, b). Sums keyed by model and cluster reach the driver; a model whose centres move by less than
    ``tol`` leaves the pass. A cluster that loses all rows keeps its centre.
    """
    some = df.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(SAMPLE).toPandas()
    a, b = np.stack(some["a"]), np.stack(some["b"])
    centres = [_first_centres(f(a, b), k, np.random.default_rng(seed)) for f in spaces]
    open_, rounds = list(range(len(spaces))), 0
    while open_ and rounds < iters:
        sizes = [c.shape for c in centres]

        def step(pdf: pd.DataFrame, open_=tuple(open_), centres=centres) -> np.ndarray:
            a, b, out = np.stack(pdf["a"]), np.stack(pdf["b"]), []
            for m in open_:
                x = spaces[m](a, b)
                one = np.eye(len(centres[m]))[_nearest_centre(x, centres[m])]
                out += [one.sum(0), (one.T @ x).ravel()]
            return np.concatenate(out)
        sums = summed(df.select("a", "b"), step, sum(sizes[m][0] * (1 + sizes[m][1]) for m in open_))
        going, at = [], 0
        for m in open_:
            rows, dim = sizes[m]
            n, total = sums[at:at + rows], sums[at + rows:at + rows * (1 + dim)].reshape(rows, dim)
            at += rows * (1 + dim)
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1.0)[:, None], centres[m])
            if np.sqrt(((new - centres[m]) ** 2).sum(1)).max() > tol:
                going.append(m)
            centres[m] = new
        open_, rounds = going, rounds + 1
    return centres, rounds


def _mixed(alpha: float, same: bool):
    def space(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (1.0 - alpha) * a + alpha * b if same else np.hstack([(1.0 - alpha) * a, alpha * b])
    return space


def alpha_labels(expr: DataFrame, oper: DataFrame, k: int, dim_e: int, dim_o: int, alphas: tuple[float, ...], seed: int = 0) -> DataFrame:
    """(cell_id, alpha, cluster) of the joint clustering for each mixing weight, all fitted in the same passes."""
    a = standardize_vectors(expr.select("cell_id", "x"), dim_e).withColumnRenamed("x", "a")
    b = standardize_vectors(oper.select("cell_id", "x"), dim_o).withColumnRenamed("x", "b")
    both = cut_lineage(a.join(b, "cell_id").select("cell_id", "a", "b"))
    spaces = [_mixed(float(x), dim_e == dim_o) for x in alphas]
    centres, _ = kmeans_models(both, spaces, k, seed=seed)

    @F.pandas_udf("array<int>")
    def labels(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = np.stack(a.to_numpy()), np.stack(b.to_numpy())
        return pd.Series(list(np.stack([_nearest_centre(f(x, y), c) for f, c in zip(spaces, centres)], 1).astype("int32")))
    named = F.arrays_zip(F.array(*[F.lit(float(x)) for x in alphas]).alias("alpha"), labels("a", "b").alias("cluster"))
    return both.select("cell_id", F.explode(named).alias("z")).select("cell_id", "z.alpha", "z.cluster")


def alpha_search(expr: DataFrame, oper: DataFrame, truth: DataFrame, k: int, dim_e: int, dim_o: int,
                 alphas: tuple[float, ...] = tuple(i / 10 for i in range(11)), seed: int = 0) -> DataFrame:
    """(alpha, ari, nmi, n_clusters, best) of the joint clustering for each mixing weight; best is the first of highest ARI."""
    lab = cut_lineage(alpha_labels(expr, oper, k, dim_e, dim_o, alphas, seed).join(truth.select("cell_id", "truth"), "cell_id"))
    out = cut_lineage(ari_nmi(lab, "truth", "cluster", ["alpha"]).join(lab.groupBy("alpha").agg(F.count_distinct("cluster").alias("n_clusters")), "alpha"))
    top = out.agg(F.max_by("alpha", F.struct("ari", -F.col("alpha"))).alias("a")).scalar()
    return out.select("alpha", "ari", "nmi", "n_clusters", (F.col("alpha") == top).alias("best"))


def cluster_purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Size, dominant label, purity and composition per cluster."""
    c = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return (c.groupBy(cluster).agg(F.sum("n").alias("size"), F.min(F.struct(-F.col("n"), label)).alias("b"),
                                   F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label).cast("string"), "n")))).alias("composition"), F.max("n").alias("_m"))
            .select(cluster, "size", F.col("b")[label].alias("dominant"), (F.col("_m") / F.col("size")).alias("purity"), "composition"))


def overall_purity(purity: DataFrame) -> DataFrame:
    """Unweighted mean purity."""
    return purity.agg(F.avg("purity").alias("overall_purity"))
