"""Exact and approximate nearest neighbours between vector tables.

Copies of a vector are folded first (a vector needs at most k+1 of its row ids). Distinct vectors are given to the fine
pivots of a two-level index (:mod:`pivots`), which bounds every query's k-th distance and drops pivots that cannot
hold a neighbour. Neighbouring pivots form blocks; a query goes once to every block it has to look into, beside the
queries of its own block, and a pair of blocks is one group: a crowded pivot is spread over many of them, a task holds
two blocks at a time, and only k rows per query and block leave it. The approximate form looks into the nearest pivots
only and compares codes of one byte a component, residuals from the pivot, before the best candidates are measured exactly.

Joins of vector tables are hinted to be shuffled: sizes estimated from compressed files make Spark broadcast them whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .pivots import PivotIndex, distances, wanted_pivots

BLOCKS = 16         # at least so many blocks, and
BLOCK_ROWS = 512    # no smaller ones than this;
BLOCK_BYTES = 8 << 20  # no block is larger than this
CHUNK = 256         # queries of a block that are compared at once
CODE = 127      # steps of a component to either side
REFINE = 5      # candidates by code for each neighbour wanted
TUNING = 256    # rows whose exact neighbours say how many pivots to look into
TARGET = 0.97   # share of those neighbours that must lie in them


def _vector_key(vec: str) -> list[Column]:
    """Two independent hashes of a vector, 128 bits that stand for it as a key."""
    return [F.xxhash64(vec).alias("h1"), F.xxhash64(F.reverse(vec), F.lit(7)).alias("h2")]


def _fold_copies(df: DataFrame, key: str, vec: str, keep: int) -> DataFrame:
    """One row per distinct vector with its ``keep`` smallest ids: (h1, h2, vid, x, ids)."""
    w = W.partitionBy("h1", "h2").orderBy("id")
    few = (df.select(F.col(key).alias("id"), F.col(vec).alias("x"), *_vector_key(vec))
           .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep))
    return few.groupBy("h1", "h2").agg(F.min_by("x", "id").alias("x"), F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vid", F.col("ids")[0])


def _pivots(folded: DataFrame, n: int) -> np.ndarray:
    """Vectors of the data, drawn by a hash of their id: about the wanted number, whatever the number of rows."""
    first = folded.select("x").first()
    count = wanted_pivots(n, len(first[0]))
    share = min(1.0, (count + 3.0 * np.sqrt(count) + 3.0) / n)
    drawn = folded.where(F.pmod(F.xxhash64("vid", F.lit(3)), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = drawn.orderBy(F.xxhash64("vid"), "vid").limit(count).select("x").collect()
    return np.array([r[0] for r in rows] or [first[0]], dtype=float)


def _assign(folded: DataFrame, index) -> DataFrame:
    @F.pandas_udf("struct<pivot:int,d:double>")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in parts:
            own, d = index.value.nearest(np.stack(x.to_numpy()))
            yield pd.DataFrame({"pivot": own.astype("int32"), "d": d})
    return folded.withColumn("_a", nearest("x")).select("*", "_a.pivot", "_a.d").drop("_a")


def _summaries(assigned: DataFrame, n_pivots: int, need: int):
    """Per pivot: vectors, nearest and farthest member, distance covering ``need`` row ids (driver, bounded by the pivots)."""
    stats = assigned.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    w = W.partitionBy("pivot").orderBy("d", "vid")
    near = assigned.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= need)
    upto = W.partitionBy("pivot").orderBy("d", "vid").rowsBetween(W.unboundedPreceding, 0)
    cover = near.withColumn("_m", F.sum(F.size("ids")).over(upto)).where(F.col("_m") >= need).groupBy("pivot").agg(F.min("d").alias("cover"))
    n, lo, hi, held = (np.zeros(n_pivots, int), np.full(n_pivots, np.inf), np.full(n_pivots, -np.inf), np.full(n_pivots, np.inf))
    for r in stats.join(cover, "pivot", "left").collect():
        n[r["pivot"]], lo[r["pivot"]], hi[r["pivot"]] = r["n"], r["lo"], r["hi"]
        held[r["pivot"]] = np.inf if r["cover"] is None else r["cover"]
    return n, lo, hi, held


def _route(queries: DataFrame, index, probes: int | None, need: int) -> DataFrame:
    """Add ``visit``, the blocks a query has to look into, and ``reach``: it looks at their pivots up to that distance."""
    @F.pandas_udf("struct<visit:array<int>,reach:double>")
    def visit(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in parts:
            blocks, reach = [], []
            for at in range(0, len(x), 1024):
                v = np.stack(x.iloc[at:at + 1024].to_numpy())
                seen, upto = index.value.visit_within(v) if probes is None else index.value.probe_within(v, probes, need)
                blocks += [index.value.blocks_of(p).astype("int32") for p in seen]
                reach.append(upto)
            yield pd.DataFrame({"visit": blocks, "reach": np.concatenate([np.zeros(0), *reach])})
    return queries.withColumn("_v", visit("x")).select("*", "_v.visit", "_v.reach").drop("_v")


def _home(assigned: DataFrame, index) -> DataFrame:
    """Add ``block``: where a row is looked for."""
    @F.pandas_udf("int")
    def home(pivot: pd.Series, hashed: pd.Series) -> pd.Series:
        return pd.Series(index.value.home(pivot.to_numpy(), hashed.to_numpy()), dtype="int32")
    return assigned.withColumn("block", home("pivot", F.pmod(F.xxhash64("vid"), F.lit(1 << 40))))


def _best(q: np.ndarray, r: np.ndarray, pivot: np.ndarray, rid: np.ndarray, reach: np.ndarray, k: int, index, exact) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, distance) of the k nearest references of each query; references are ordered by their pivot.

    Without ``exact`` references count by their pivot's distance alone and ``r`` holds what is left of them beside it.
    """
    starts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
    ends, centres = np.r_[starts[1:], len(pivot)], index.pivots[pivot[starts]]
    rr = (r * r).sum(1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), CHUNK):
        x, bound = q[at:at + CHUNK], reach[at:at + CHUNK].copy()
        to = distances(x, centres)
        top = np.full((len(x), k), np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for p in np.argsort(to.min(0), kind="stable"):
            if exact:
                rows = np.flatnonzero((to[:, p] - index.hi[pivot[starts[p]]] <= bound) & (index.lo[pivot[starts[p]]] - to[:, p] <= bound))
            else:
                rows = np.flatnonzero(to[:, p] <= bound)
            if not len(rows):
                continue
            some = slice(starts[p], ends[p])
            y = x[rows] if exact else x[rows] - centres[p]
            yy = (y * y).sum(1)
            d2 = np.maximum(yy[:, None] - 2.0 * y @ r[some].T + rr[None, some], 0.0)
            tol = 1e-11 * (yy.max() + rr[some].max())
            top[rows] = np.partition(np.hstack([top[rows], d2]), k - 1, axis=1)[:, :k]
            kth = top[rows].max(1)
            i, j = np.nonzero(d2 <= kth[:, None] + tol)  # everything within rounding of the k-th, then measured
            d = np.sqrt(((y[i] - r[starts[p] + j]) ** 2).sum(1)) if exact else np.sqrt(d2[i, j])
            found.append((rows[i], starts[p] + j, d))
            if exact:
                bound[rows] = np.minimum(bound[rows], np.sqrt(kth + tol) + index.slack)
        if found:
            i, j, d = (np.concatenate(z) for z in zip(*found))
            order = np.lexsort((rid[j], d, i))
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            out.append((at + i[place < k], j[place < k], d[place < k]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _pair_search(k: int, index, exact: bool):
    """The queries of one block against the references of another: k best reference vectors per query."""
    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"qid": [], "rid": [], "dist": []})
        r = r.sort_values("pivot", kind="stable")
        if exact:
            refs = np.stack(r["x"].to_numpy())
        else:
            refs = np.stack([np.frombuffer(c, dtype=np.int8) for c in r["code"]]).astype(float) * r["scale"].to_numpy()[:, None]
        rid, qid = r["vid"].to_numpy(), q["vid"].to_numpy()
        i, j, d = _best(np.stack(q["x"].to_numpy()), refs, r["pivot"].to_numpy(), rid, q["reach"].to_numpy(), k, index.value, exact)
        return pd.DataFrame({"qid": qid[i], "rid": rid[j], "dist": d})
    return run


def _coded(assigned: DataFrame, index) -> DataFrame:
    """Add ``code`` and ``scale``: the vector less its pivot, a byte a component."""
    @F.pandas_udf("struct<code:binary,scale:double>")
    def code(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, pivot in parts:
            rest = np.stack(x.to_numpy()) - index.value.pivots[pivot.to_numpy()]
            scale = np.maximum(np.abs(rest).max(1), 1e-300) / CODE
            steps = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pd.DataFrame({"code": [c.tobytes() for c in steps], "scale": scale})
    return assigned.withColumn("_c", code("x", "pivot")).select("vid", "pivot", "block", "_c.code", "_c.scale")


def _measured(found: DataFrame, queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Candidates (qid, rid) with the exact distance; the vectors come by row id."""
    @F.pandas_udf("double")
    def dist(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt(((np.stack(a.to_numpy()) - np.stack(b.to_numpy())) ** 2).sum(1))) if len(a) else pd.Series([], dtype=float)
    q, r = queries.select(F.col("vid").alias("qid"), F.col("x").alias("_q")), refs.select(F.col("vid").alias("rid"), F.col("x").alias("_x"))
    return found.select("qid", "rid").join(q.hint("merge"), "qid").join(r.hint("merge"), "rid").select("qid", "rid", dist("_q", "_x").alias("dist"))


def knn(refs: DataFrame, k: int, queries: DataFrame | None = None, key: str = "cell_id", vec: str = "x",
        probes: int | None = None, block_rows: int | None = None, refine: int = REFINE) -> DataFrame:
    """k nearest reference rows of every query row by Euclidean distance: (src, dst, dist, rnk).

    Without ``queries`` the table is searched against itself and a row is not its own neighbour. Ties go to the smaller
    id. ``probes`` limits the search to that many nearest pivots, and to more where those hold too few rows, and makes
    it approximate: the best ``refine`` * k rows by their codes are measured exactly. Fewer than k rows come back only
    if the table has no more.
    """
    itself = queries is None
    need = k + 1 if itself else k
    spark = refs.sparkSession
    folded = cut_lineage(_fold_copies(refs, key, vec, need))
    n = folded.count()
    if not n:
        ids = dict(refs.dtypes)[key]
        return spark.createDataFrame([], f"src {ids}, dst {ids}, dist double, rnk int")
    made = PivotIndex(_pivots(folded, n))
    assigned = cut_lineage(_assign(folded, spark.sparkContext.broadcast(made)))
    made.bound(*_summaries(assigned, len(made.pivots), need))
    made.blocked(block_rows or max(1, min(max(BLOCK_ROWS, n // BLOCKS), BLOCK_BYTES // (8 * made.pivots.shape[1]))))
    index = spark.sparkContext.broadcast(made)
    homed = cut_lineage(_home(assigned, index))
    placed = homed if probes is None else _coded(homed, index)

    q = homed.select("h1", "h2", "vid", "x", F.col("block").alias("qb"))
    if not itself:
        q = cut_lineage(_assign(_fold_copies(queries, key, vec, 1), index).select("h1", "h2", "vid", "x", "pivot"))
        q_blocks = max(1, -(-q.count() // max(1, n // made.blocks)))
        q = q.withColumn("qb", F.pmod(F.xxhash64("vid", F.lit(7)), F.lit(q_blocks)).cast("int"))
    looks = cut_lineage(_route(q.select("vid", "x", "qb"), index, probes, refine * need))
    meets = looks.select("qb", F.explode("visit").alias("block")).distinct()  # pairs of blocks
    asked = looks.select(F.col("qb").alias("qb"), F.explode("visit").alias("block"), F.col("vid").alias("vid"), F.col("x").alias("x"), "reach")
    columns = ["vid", "pivot", "x"] if probes is None else ["vid", "pivot", "code", "scale"]
    refs_by = placed.join(meets, "block").select(*[F.col(c).alias(c) for c in ("qb", "block", *columns)])
    key_t = dict(refs.dtypes)[key]
    schema = f"qid {key_t}, rid {key_t}, dist double"
    w = W.partitionBy("qid").orderBy("dist", "rid")
    first = lambda found, m: found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= m).drop("_r")
    wanted = need if probes is None else refine * need
    found = (asked.groupBy("qb", "block").cogroup(refs_by.groupBy("qb", "block"))
             .applyInPandas(_pair_search(wanted, index, probes is None), schema))
    if probes is not None:
        found = _measured(first(found, wanted), q, folded)
    # at most ``need`` vectors with ``need`` ids each per query vector
    best = first(found, need).join(folded.select(F.col("vid").alias("rid"), "ids").hint("merge"), "rid")
    lists = best.groupBy("qid").agg(F.sort_array(F.flatten(F.collect_list(
        F.transform("ids", lambda i: F.struct(F.col("dist").alias("dist"), i.alias("dst")))))).alias("nb"))
    lists = lists.withColumn("nb", F.slice("nb", 1, need))
    members = (refs if itself else queries).select(F.col(key).alias("src"), *_vector_key(vec))
    members = members.join(q.select("h1", "h2", F.col("vid").alias("qid")).hint("merge"), ["h1", "h2"]).select("src", "qid")
    out = members.join(lists.hint("merge"), "qid")
    if itself:
        out = out.withColumn("nb", F.slice(F.filter("nb", lambda s: s["dst"] != F.col("src")), 1, k))
    return (out.select("src", F.posexplode("nb").alias("p", "s"))
            .select("src", F.col("s.dst").alias("dst"), F.col("s.dist").alias("dist"), (F.col("p") + 1).cast("int").alias("rnk")))


def tuned_probes(refs: DataFrame, k: int, key: str = "cell_id", vec: str = "x", target: float = TARGET, rows: int = TUNING) -> int:
    """How many nearest pivots hold ``target`` of the exact neighbours of ``rows`` rows, which are drawn by a hash of their id."""
    spark = refs.sparkSession
    folded = cut_lineage(_fold_copies(refs, key, vec, 1))
    n = folded.count()
    if not n:
        return 1
    index = spark.sparkContext.broadcast(PivotIndex(_pivots(folded, n)))
    some = folded.orderBy(F.xxhash64("vid", F.lit(9)), "vid").limit(rows).select(F.col("vid").alias("_id"), F.col("x").alias("_x"))
    asked = cut_lineage(some.withColumnsRenamed({"_id": key, "_x": vec}))
    true = knn(folded.select(F.col("vid").alias(key), F.col("x").alias(vec)), k + 1, asked, key, vec)
    pairs = (true.join(asked.select(F.col(key).alias("src"), F.col(vec).alias("_q")), "src").join(folded.select(F.col("vid").alias("dst"), F.col("x").alias("_x")), "dst")
             .where(F.col("src") != F.col("dst")))

    @F.pandas_udf("int")
    def place(q: pd.Series, x: pd.Series) -> pd.Series:
        if not len(q):
            return pd.Series([], dtype="int32")
        pivots = index.value.pivots
        own, _ = index.value.nearest(np.stack(x.to_numpy()))
        to = distances(np.stack(q.to_numpy()), pivots)
        return pd.Series((to < to[np.arange(len(own)), own][:, None]).sum(1) + 1)
    places = pairs.select(place("_q", "_x").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row per pivot at most
    total, seen = sum(r["n"] for r in places), 0
    for r in places:
        seen += r["n"]
        if seen >= target * total:
            return int(r["p"])
    return 1


def knn_approx(refs: DataFrame, k: int, probes: int | None = None, key: str = "cell_id", vec: str = "x", **kw) -> DataFrame:
    """Neighbours among the nearest few pivots by residual codes; without ``probes`` their number is tuned on a bounded sample.

    :func:`recall` measures what is lost.
    """
    return knn(refs, k, key=key, vec=vec, probes=probes or tuned_probes(refs, k, key, vec), **kw)


def recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    hit = exact.select("src", "dst").join(approx.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.count(F.lit(1)).alias("h"))
    return exact.agg((hit.scalar() / F.count(F.lit(1))).alias("recall"))


def kth_distance(edges: DataFrame, k: int, lo: float = 0.05, hi: float = 0.5) -> DataFrame:
    """Per row the k-th neighbour distance clamped to [lo, hi]."""
    d = F.max(F.when(F.col("rnk") == k, F.col("dist")))
    return edges.groupBy("src").agg(F.greatest(F.lit(lo), F.least(F.lit(hi), d)).alias("scale"))


def knn_interpolate(edges: DataFrame, reference: DataFrame, dim: int, tau: float = 1.0) -> DataFrame:
    """softmax(-d^2/tau)-weighted neighbour vector and confidence: (src, v, conf).

    ``reference`` is (cell_id, v); confidence of a reference row is its norm over the largest norm.
    """
    from ..functions.scalars import stat
    from ..functions.vectors import norm, sum_vectors
    ref = reference.select(F.col("cell_id").alias("dst"), "v", norm("v").alias("_n"))
    top = stat(ref, m=F.max("_n"))
    ref = ref.withColumn("_conf", F.col("_n") / (top["m"] + F.lit(1e-8)))
    shift = edges.groupBy("src").agg(F.max(-F.col("dist") * F.col("dist") / F.lit(tau)).alias("_m"))
    w = edges.join(shift, "src").withColumn("_w", F.exp(-F.col("dist") * F.col("dist") / F.lit(tau) - F.col("_m")))
    got = w.join(ref, "dst").groupBy("src").agg(
        sum_vectors("v", dim, F.col("_w")).alias("_sv"), F.sum(F.col("_w") * F.col("_conf")).alias("_sc"), F.sum("_w").alias("_sw"))
    return got.select("src", F.transform("_sv", lambda a: a / F.col("_sw")).alias("v"), (F.col("_sc") / F.col("_sw")).alias("conf"))


def knn_overlap(a: DataFrame, b: DataFrame, k: int, labels: DataFrame | None = None) -> DataFrame:
    """Share of neighbours two graphs have in common, per row, or its mean per cluster of ``labels``."""
    both = a.select("src", "dst").join(b.select("src", "dst"), ["src", "dst"]).groupBy("src").agg(F.count(F.lit(1)).alias("_c"))
    rows = a.select("src").distinct().join(both, "src", "left").select(
        "src", (F.coalesce("_c", F.lit(0)) / F.lit(k)).alias("overlap"))
    if labels is None:
        return rows
    return (rows.join(labels.select(F.col("cell_id").alias("src"), "cluster"), "src")
            .groupBy("cluster").agg(F.avg("overlap").alias("overlap"), F.count(F.lit(1)).alias("n")))
