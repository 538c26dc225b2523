"""Operators on edge tables (src, dst, w), range joins and communication tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.scalars import stat
from ..functions.vectors import mean_vectors, sq_dist, sub, sum_vectors
from ..session import cut_lineage, cut_to_table


def symmetric_graph(edges: DataFrame, weight: str = "dist") -> DataFrame:
    """Half of A plus its transpose, as (src, dst, w)."""
    e = edges.select("src", "dst", F.col(weight).alias("w"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return e.union(back).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))


def graph_laplacian(graph: DataFrame) -> DataFrame:
    """I - D^-1/2 A D^-1/2 as edges, diagonal included."""
    deg = graph.groupBy("src").agg(F.sum("w").alias("deg"))
    off = (graph.where(F.col("src") != F.col("dst")).join(deg.withColumnRenamed("deg", "ds"), "src")
           .join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("dd")), "dst")
           .select("src", "dst", F.coalesce(F.try_divide(-F.col("w"), F.sqrt(F.col("ds") * F.col("dd"))), F.lit(0.0)).alias("w")))
    return off.union(deg.select("src", F.col("src").alias("dst"), F.when(F.col("deg") > 0, 1.0).otherwise(0.0).alias("w")))


def proximal_join(points: DataFrame, intervals: DataFrame, reach: int, by: str | None = None, summary: bool = False) -> DataFrame:
    """Pairs on the same chrom with |centre - pos| <= reach, both ends included.

    ``points`` is (point_id, chrom, pos), ``intervals`` (interval_id, chrom, centre). Positions are cut
    into buckets of the reach; a point looks into its own and the two adjacent buckets, so every pair
    meets in exactly one bucket and the join stays an equi-join.

    Pairs grow with the square of the rows. Two results of them are found without them: ``summary`` has per point the number
    of its pairs, the sum of their offsets and the smallest interval (point_id, n, total, first), for whole-number
    positions; ``by`` names a column of the points and has the distinct (by, interval_id).
    """
    if summary:
        return _proximal_summary(points, intervals, reach)
    if by is not None:
        return _proximal_groups(points, intervals, reach, by)
    width = F.lit(max(1, reach))
    p = points.withColumn("_b", F.floor(F.col("pos") / width))
    p = p.withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    i = intervals.withColumn("_b", F.floor(F.col("centre") / width))
    hit = p.join(i, ["chrom", "_b"]).where(F.abs(F.col("centre") - F.col("pos")) <= F.lit(reach))
    return hit.select("point_id", "interval_id", "chrom", (F.col("centre") - F.col("pos")).alias("offset"))


def _proximal_summary(points: DataFrame, intervals: DataFrame, reach: int) -> DataFrame:
    """Equal positions are counted rows; the axis is cut into blocks as long as a point's window, so
    that a window is the end of one block and the beginning of the next, and running sums within a block give both.
    """
    size, r = F.lit(2 * reach + 1), F.lit(reach)
    at = (intervals.where(F.col("chrom").isNotNull() & F.col("centre").isNotNull()).groupBy("chrom", F.col("centre").cast("long").alias("at"))
          .agg(F.count(F.lit(1)).alias("k"), F.min("interval_id").alias("f"))
          .select("chrom", "at", "k", (F.col("at") * F.col("k")).alias("s"), "f", F.lit(0).alias("ask")))
    places = points.where(F.col("chrom").isNotNull()).select("chrom", F.col("pos").cast("long").alias("pos")).where(F.col("pos").isNotNull()).distinct()
    # 1: the end of a block from ``at`` on, 2: its beginning up to ``at``; a window that is one block is its end alone
    asks = F.array(F.struct((F.col("pos") - r).alias("at"), F.lit(1).alias("ask")), F.struct((F.col("pos") + r).alias("at"), F.lit(2).alias("ask")))
    asked = places.select("chrom", "pos", F.explode(asks).alias("q")).where((F.col("q.ask") == 1) | (F.pmod(F.col("pos") - r, size) != 0))
    kind = dict(intervals.dtypes)["interval_id"]
    rows = at.withColumn("pos", F.lit(None).cast("long")).unionByName(asked.select(
        "chrom", "pos", "q.at", "q.ask", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("s"), F.lit(None).cast(kind).alias("f")))
    rows = rows.withColumn("_b", F.floor(F.col("at") / size))
    upto = lambda way: W.partitionBy("chrom", "_b").orderBy(way).rangeBetween(W.unboundedPreceding, W.currentRow)
    begin, end = upto(F.col("at").asc()), upto(F.col("at").desc())
    names = {"k": F.sum, "s": F.sum, "f": F.min}
    both = rows.withColumns({f"{c}{w}": g(c).over(o) for c, g in names.items() for w, o in ((1, end), (2, begin))}).where(F.col("ask") > 0)
    per = both.select("chrom", "pos", *[F.when(F.col("ask") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(c) for c in names])
    per = per.groupBy("chrom", "pos").agg(F.sum("k").alias("n"), F.sum("s").alias("s"), F.min("f").alias("first")).where(F.col("n") > 0)
    per = per.select("chrom", "pos", "n", (F.col("s") - F.col("n") * F.col("pos")).alias("total"), "first")
    whole = points.withColumn("pos", F.col("pos").cast("long")).join(per, ["chrom", "pos"])
    return whole.groupBy("point_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("first").alias("first"))


def _proximal_groups(points: DataFrame, intervals: DataFrame, reach: int, by: str) -> DataFrame:
    """Per bucket of the reach only the first and last position of a ``by`` matter: whatever lies in an interval's own bucket
    is near, of the bucket before it the last, of the one behind it the first. Rows grow with the result, not with the pairs.
    """
    width = F.lit(max(1, reach))
    ends = points.groupBy(by, "chrom", F.floor(F.col("pos") / width).alias("_b")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    shown = F.array(*[F.struct((F.col("_b") + d).alias("b"), F.when(F.lit(d >= 0), F.col("hi")).alias("hi"), F.when(F.lit(d <= 0), F.col("lo")).alias("lo")) for d in (-1, 0, 1)])
    near = (ends.select(by, "chrom", F.explode(shown).alias("z")).select(by, "chrom", F.col("z.b").alias("_b"), "z.hi", "z.lo"))
    i = intervals.withColumn("_b", F.floor(F.col("centre") / width))
    hit = i.join(near, ["chrom", "_b"]).where((F.abs(F.col("centre") - F.col("hi")) <= F.lit(reach)) | (F.abs(F.col("lo") - F.col("centre")) <= F.lit(reach)))
    return hit.select(by, "interval_id").distinct()


def regulon_peaks(network: DataFrame, intervals: DataFrame, genes: DataFrame, reach: int | None = None) -> DataFrame:
    """(source, interval_id): distinct peaks near the targets of each regulator that are in the data.

    ``intervals`` are peaks (interval_id, chrom, centre) near which ``genes`` (point_id, chrom, pos) are looked for, or,
    without ``reach``, the pairs of :func:`proximal_join`.
    """
    if reach is not None:
        at = network.select("source", "target").join(genes.select(F.col("point_id").alias("target"), "chrom", "pos"), "target")
        return proximal_join(at, intervals, reach, by="source")
    targets = network.join(genes.select(F.col("point_id").alias("target")), "target", "left_semi").select("source", "target").distinct()
    return (targets.join(intervals.select(F.col("point_id").alias("target"), "interval_id"), "target")
            .select("source", "interval_id").distinct())


def accessibility_score(expr: DataFrame, peaks: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Per cell and peak set (source): sum of values over the set divided by the set's size.

    Sparse by default (an absent row scores 0); ``cells`` (cell_id, source) asks for those rows to be filled.
    """
    size = peaks.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    got = (expr.join(peaks.withColumnRenamed("interval_id", "feature"), "feature")
           .groupBy("cell_id", "source").agg(F.sum("value").alias("_s")))
    rows = got if cells is None else cells.select("cell_id", "source").join(got, ["cell_id", "source"], "left")
    return rows.join(size, "source").select("cell_id", "source", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("score"))


def cluster_adjacency(means: DataFrame, pvals: DataFrame, alpha: float = 0.05, lr_weights: DataFrame | None = None) -> DataFrame:
    """Interaction strength by (time, sender, receiver): sum of mean * [p <= alpha] * weight."""
    key = ["time", "sender", "receiver", "ligand", "receptor"]
    df = means.withColumnRenamed("value", "m").join(pvals.withColumnRenamed("value", "p"), key)
    w = F.lit(1.0)
    if lr_weights is not None:
        df = df.join(lr_weights.select("ligand", "receptor", "w_lr"), ["ligand", "receptor"], "left")
        w = F.coalesce("w_lr", F.lit(1.0))
    edge = F.col("m") * F.when(F.col("p") <= alpha, 1.0).otherwise(0.0) * w
    return df.groupBy("time", "sender", "receiver").agg(F.sum(edge).alias("a"))


def lift_to_cells(adjacency: DataFrame, cells: DataFrame, edges: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Cluster adjacency of one time point carried to neighbouring cells, rows normalised.

    Only the pairs in ``edges`` are formed; the dense cell-by-cell product is never built.
    """
    c = cells.select("cell_id", "cluster")
    w = (edges.select("src", "dst")
         .join(c.select(F.col("cell_id").alias("src"), F.col("cluster").alias("sender")), "src")
         .join(c.select(F.col("cell_id").alias("dst"), F.col("cluster").alias("receiver")), "dst")
         .join(adjacency.select("sender", "receiver", "a"), ["sender", "receiver"]))
    tot = w.groupBy("src").agg(F.sum("a").alias("_t"))
    return w.join(tot, "src").select("src", "dst", (F.col("a") / (F.col("_t") + F.lit(eps))).alias("w"))


def interaction_term(weights: DataFrame, latent: DataFrame, dim: int, gain: float = 1.0) -> DataFrame:
    """u_i = gain * sum_j W_ij (x_j - x_i)."""
    x = latent.select("cell_id", "x")
    j = (weights.join(x.select(F.col("cell_id").alias("src"), F.col("x").alias("xi")), "src")
         .join(x.select(F.col("cell_id").alias("dst"), F.col("x").alias("xj")), "dst")
         .withColumn("_d", sub("xj", "xi")))
    return j.groupBy("src").agg(sum_vectors("_d", dim, F.col("w") * F.lit(gain)).alias("u"))


def root_cell(latent: DataFrame, dim: int, by: str = "cluster") -> DataFrame:
    """Per cluster the row nearest to the cluster's centroid (smaller id on ties)."""
    cen = latent.groupBy(by).agg(mean_vectors("x", dim).alias("c"))
    d = latent.join(cen, by).select(by, "cell_id", sq_dist("x", "c").alias("d2"))
    return d.groupBy(by).agg(F.min(F.struct("d2", "cell_id")).alias("m")).select(by, F.col("m.cell_id").alias("root"))


MERGE = 8      # rounds of arrivals that are added up at once
BUCKETS = 8    # mean edge weights that a distance bucket spans


def _near_first(both: DataFrame, d: DataFrame, changed: DataFrame, limit: float) -> DataFrame:
    """Relax the edges of changed rows nearer than ``limit``: (cell_id, d, open), open if a row has changed now or still waits."""
    now = changed.where(F.col("d") < limit)
    step = both.join(now.withColumnRenamed("cell_id", "src"), "src").groupBy(F.col("dst").alias("cell_id")).agg(F.min(F.col("d") + F.col("w")).alias("nd"))
    whole = d.join(step, "cell_id", "left").withColumn("_new", F.col("nd").isNotNull() & (F.col("d").isNull() | (F.col("nd") < F.col("d"))))
    waiting = changed.where(F.col("d") >= limit).select("cell_id", F.lit(True).alias("_wait"))
    whole = whole.join(waiting, "cell_id", "left").select("cell_id", F.when(F.col("_new"), F.col("nd")).otherwise(F.col("d")).alias("d"), (F.col("_new") | F.coalesce("_wait", F.lit(False))).alias("open"))
    return whole


def graph_pseudotime(edges: DataFrame, root, cells: DataFrame | None = None, weight: str = "dist", log: list | None = None) -> DataFrame:
    """Ordering by shortest path length from the root, relaxed until no distance changes.

    Only edges of rows whose distance has changed are looked at, nearest rows first: rows beyond the current distance
    bucket wait until nothing nearer changes, so that few distances are set twice. ``log`` takes the number of open
    rows before each round.

    Rows without a path to the root keep a null distance and take the median on the axis, which is then
    min-max scaled: (cell_id, d, t).
    """
    e = symmetric_graph(edges, weight)
    nodes = (cells.select("cell_id") if cells is not None
             else e.select(F.col("src").alias("cell_id")).union(e.select("dst")).distinct())
    out_edges = edges.select("src", "dst", F.col(weight).alias("w"))
    both = out_edges.union(out_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    both = cut_lineage(both.groupBy("src", "dst").agg(F.min("w").alias("w")).repartition("src"))
    mean = both.agg(F.avg("w")).first()[0] or 0.0
    first = F.col("cell_id") == root
    state = cut_to_table(nodes.select("cell_id", F.when(first, 0.0).cast("double").alias("d"), F.coalesce(first, F.lit(False)).alias("open")))
    limit = BUCKETS * mean
    while True:
        seen = state.agg(F.sum(F.when(F.col("open"), 1).otherwise(0)).alias("n"), F.min(F.when(F.col("open"), F.col("d"))).alias("lo")).first()
        if log is not None:
            log.append(seen["n"] or 0)
        if not seen["n"]:
            break
        if mean <= 0:
            limit = float("inf")
        elif seen["lo"] >= limit:
            limit = seen["lo"] + BUCKETS * mean
        state = cut_to_table(_near_first(both, state.select("cell_id", "d"), state.where("open").select("cell_id", "d"), limit))
    d = state.select("cell_id", "d")
    med = ranking.quantile_scalar(d, "d", 0.5)
    s = stat(d, lo=F.min("d"), hi=F.max("d"))
    full = F.coalesce(F.col("d"), med)
    return d.select("cell_id", "d", ((full - s["lo"]) / (s["hi"] - s["lo"] + F.lit(1e-8))).alias("t"))


def _row_normalise(edges: DataFrame) -> DataFrame:
    tot = edges.groupBy("src").agg(F.sum("w").alias("_t"))
    return edges.join(tot, "src").select("src", "dst", F.coalesce(F.try_divide(F.col("w"), F.col("_t")), F.lit(0.0)).alias("w"))


def graph_smooth(edges: DataFrame, values: DataFrame, rounds: int, keep: float = 0.0, checkpoint_every: int = 4) -> DataFrame:
    """Diffuse (cell_id, feature, value) over row-normalised edges for ``rounds`` steps.

    ``keep`` is the share a row retains of its own value in each step.
    """
    p = cut_lineage(_row_normalise(edges))
    out = values.select("cell_id", "feature", "value")
    for i in range(rounds):
        moved = (p.join(out.withColumnRenamed("cell_id", "dst"), "dst")
                 .select(F.col("src").alias("cell_id"), "feature", (F.col("w") * F.col("value") * F.lit(1.0 - keep)).alias("value")))
        own = out.select("cell_id", "feature", (F.col("value") * F.lit(keep)).alias("value"))
        out = (moved.union(own) if keep else moved).groupBy("cell_id", "feature").agg(F.sum("value").alias("value"))
        if (i + 1) % checkpoint_every == 0:
            out = cut_lineage(out)
    return out


def absorb_probabilities(edges: DataFrame, axis: DataFrame, terminals: DataFrame, log: list | None = None) -> DataFrame:
    """Branch probabilities by walking forward along the axis until a terminal row is met, for walks of any length.

    A round moves only the probability that arrived in the round before, back over the edges that lead there; edges
    lead forward, so it ends with the longest walk. ``log`` takes the rows still moving after each round.

    ``edges`` (src, dst, w), ``axis`` (cell_id, t), ``terminals`` (cell_id, branch). Only edges to a
    later row are used and terminals keep their label: (cell_id, branch, prob).
    """
    a = axis.select("cell_id", "t")
    fwd = (edges.join(a.select(F.col("cell_id").alias("src"), F.col("t").alias("ts")), "src")
           .join(a.select(F.col("cell_id").alias("dst"), F.col("t").alias("td")), "dst")
           .where(F.col("td") > F.col("ts")).select("src", "dst", "w")
           .join(terminals.select(F.col("cell_id").alias("src")), "src", "left_anti"))
    fwd = cut_lineage(_row_normalise(fwd).repartition("dst"))
    moving = cut_lineage(terminals.select("cell_id", "branch", F.lit(1.0).alias("prob")))
    arrived, left = moving, True
    while left:
        for _ in range(MERGE):
            moving = cut_to_table(fwd.join(moving.withColumnRenamed("cell_id", "dst"), "dst").groupBy(F.col("src").alias("cell_id"), "branch")
                                 .agg(F.sum(F.col("w") * F.col("prob")).alias("prob")))
            left = moving.count()
            if log is not None:
                log.append(left)
            if not left:
                break
            arrived = arrived.unionAll(moving)
        arrived = cut_lineage(arrived.groupBy("cell_id", "branch").agg(F.sum("prob").alias("prob")))
    return arrived


def target_edge_filter(network: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges whose target is among the given features."""
    return network.join(genes.select(F.col("feature").alias("target")), "target", "left_semi").select("source", "target", "weight")
