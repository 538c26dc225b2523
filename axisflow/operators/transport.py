"""Entropic transport between two row sets.

Two forms: over a given cost table (i, j, c), and between two point sets, where packed blocks of rows are compared
inside a task and only per-row partial sums leave it, so the pairs are never written out.

Both go from coarse to fine and stop at a tolerance on the marginals. The table form keeps its kernel in two
partitionings, so a half-step moves the scalings alone; epsilon falls by steps, and after each step the potentials go
into the kernel and entries too small to matter leave it. The point form solves the cells of both sets first, starts
from their potentials, and compares only pairs of cells whose bounds say that they can contribute. Pairs of blocks are
written once with their vectors, so a half-step moves potentials and partial sums alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, ranking
from ..functions.vectors import norm, sub, sum_vectors
from ..session import cut_lineage
from .neighbors import knn
from .pivots import PivotIndex, distances

BLOCKS = 16           # blocks of a point set, at least so many, and
BLOCK_ROWS = 512      # no smaller ones than this;
MOST_ROWS = 8192      # no larger ones than this, or
BLOCK_BYTES = 4 << 20  # than this
PAIRS_PER_TASK = 4    # pairs of blocks that a task holds
TILE = 256            # rows of a block that are compared at once
CELL_ROWS = 256       # rows a cell of a point set is meant to hold, and
MOST_CELLS = 512      # cells at most; crowded cells are cut into blocks
ROUNDS_PER_CUT = 4    # rounds between two looks at the error, over a cost table
POINT_ROUNDS = 3      # and over points
TOLERANCE = 1e-6      # summed difference between the row masses and the marginal
FALL = 4.0            # by which epsilon falls
ROUGH = 1e-2          # tolerance before the last epsilon
HELD_SUMS = 4_000_000  # numbers of all keys that a task adds up before it hands them on
FAR = 200.0           # logarithm of a scaling from which the potentials go into the kernel again


def pair_cost(x: DataFrame, y: DataFrame, k: int) -> DataFrame:
    """Squared Euclidean cost of every x row to its k nearest y rows and the reverse: (i, j, c)."""
    a = knn(y, k, queries=x).select(F.col("src").alias("i"), F.col("dst").alias("j"), "dist")
    b = knn(x, k, queries=y).select(F.col("dst").alias("i"), F.col("src").alias("j"), "dist")
    return a.union(b).groupBy("i", "j").agg(F.pow(F.min("dist"), 2).alias("c"))


def _scalings(kernel: DataFrame, known: DataFrame, at: str, other: str, mass: float) -> DataFrame:
    """One half-step: (at, s) with s = mass / sum_other k * s(other). The kernel lies by ``other``."""
    sums = kernel.join(known.select(other, F.col("s").alias("_w")).hint("shuffle_hash"), other).groupBy(at).agg(F.sum(F.col("k") * F.col("_w")).alias("_k"))
    return sums.select(at, (F.lit(mass) / F.col("_k")).alias("s"))


def sinkhorn(cost: DataFrame, eps: float, iters: int = 1000, tol: float = TOLERANCE, partitions: int | None = None) -> dict:
    """Log-domain scaling of a cost table with uniform marginals over its rows and columns.

    Returns potentials f (i, p) and g (j, p) with the mean of g at 0, the plan (i, j, c, p), the rounds done and the
    error reached: the summed difference of the row masses to 1/n. Column masses are exact. Rows of the table are
    distinct pairs; pairs that are not in it carry no mass. It stops at ``tol`` or after ``iters`` rounds.
    """
    spark = cost.sparkSession
    cost = cost.select("i", "j", F.col("c").cast("double").alias("c"))
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_i = cut_lineage(cost.repartition(n_parts, "i"))
    stats = by_i.agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    f, g = cut_lineage(by_i.select("i").distinct().withColumn("p", F.lit(0.0))), cut_lineage(by_i.select("j").distinct().withColumn("p", F.lit(0.0)))
    if not stats["n"]:
        return {"f": f, "g": g, "plan": by_i.withColumn("p", F.lit(0.0)), "rounds": 0, "error": 0.0}
    a, b = 1.0 / f.count(), 1.0 / g.count()
    steps = [eps]
    while steps[0] * 8.0 < stats["hi"] - stats["lo"]:
        steps.insert(0, steps[0] * FALL)
    rounds, error = 0, float("inf")
    for e in steps:
        want = tol if e == eps else max(tol, ROUGH)
        drop = 0.0
        while True:
            # potentials into the kernel: each is joined where it lies, so the table moves twice
            k = F.exp((F.col("_f") + F.col("_g") - F.col("c")) / F.lit(e))
            both = by_i.join(f.select("i", F.col("p").alias("_f")), "i").repartition(n_parts, "j").join(g.select("j", F.col("p").alias("_g")), "j")
            k_by_j = cut_lineage(both.select("i", "j", k.alias("k")).where(F.col("k") > F.lit(drop)).repartition(n_parts, "j"))
            k_by_i = cut_lineage(k_by_j.repartition(n_parts, "i"))
            u, v = f.select("i", F.lit(1.0).alias("s")), g.select("j", F.lit(1.0).alias("s"))
            while True:
                # a half-step is computed once: the last two are cut one after the other, and only the last u meets the one before
                for _ in range(ROUNDS_PER_CUT - 1):
                    u = _scalings(k_by_j, v, "i", "j", a)
                    v = _scalings(k_by_i, u, "j", "i", b)
                before = u.select("i", F.col("s").alias("o"))
                u = cut_lineage(_scalings(k_by_j, v, "i", "j", a).join(before, "i"))
                v, rounds = cut_lineage(_scalings(k_by_i, u, "j", "i", b)), rounds + ROUNDS_PER_CUT
                seen = u.agg(F.sum(F.abs(F.col("o") / F.col("s") - 1.0) * a).alias("error"), F.max(F.abs(F.log("s"))).alias("far")).first()
                error = seen["error"]
                if error <= want or rounds >= iters or seen["far"] > FAR:
                    break
            f = cut_lineage(f.join(u, "i").select("i", (F.col("p") + F.lit(e) * F.log("s")).alias("p")))
            g = cut_lineage(g.join(v, "j").select("j", (F.col("p") + F.lit(e) * F.log("s")).alias("p")))
            if error <= want or rounds >= iters:
                break
            drop = tol * a * b * 1e-3 / stats["n"]  # what all dropped entries together can weigh is far below the tolerance
        if rounds >= iters:
            break
    shift = g.agg(F.avg("p").alias("m")).first()["m"]
    f, g = f.select("i", (F.col("p") + shift).alias("p")), g.select("j", (F.col("p") - shift).alias("p"))
    plan = (by_i.join(f.withColumnRenamed("p", "f"), "i").join(g.withColumnRenamed("p", "g"), "j")
            .select("i", "j", "c", F.exp((F.col("f") + F.col("g") - F.col("c")) / F.lit(float(eps))).alias("p")))
    return {"f": f, "g": g, "plan": plan, "rounds": rounds, "error": error}


def transport_cost(plan: DataFrame) -> Column:
    return plan.agg(F.sum(F.col("p") * F.col("c")).alias("cost")).scalar()


class _Cells:
    """A point set packed into blocks of neighbouring cells, a row each; per cell its centre, radius and rows."""

    def __init__(self, points: DataFrame, block_rows: int | None):
        spark = points.sparkSession
        n = points.count()
        wanted = max(1, min(MOST_CELLS, n // CELL_ROWS))
        drawn = points.orderBy(F.xxhash64("cell_id", F.lit(5)), "cell_id").limit(wanted).select("x").collect()
        index = PivotIndex(np.array([r[0] for r in drawn], dtype=float))
        held = spark.sparkContext.broadcast(index)

        @F.pandas_udf("struct<c:int,d:double>")
        def near(x: pd.Series) -> pd.DataFrame:
            own, d = held.value.nearest(np.stack(x.to_numpy()), cells=len(held.value.coarse))
            return pd.DataFrame({"c": own.astype("int32"), "d": d})
        placed = cut_lineage(points.withColumn("_a", near("x")).select("cell_id", "x", "_a.c", "_a.d"))
        self.n, self.centres = n, index.pivots
        self.size, self.radius = np.zeros(len(index.pivots)), np.zeros(len(index.pivots))
        for r in placed.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect():
            self.size[r["c"]], self.radius[r["c"]] = r["n"], r["r"]
        index.count = self.size.astype(int)
        index.blocked(block_rows or max(BLOCK_ROWS, min(n // BLOCKS, MOST_ROWS, BLOCK_BYTES // (8 * index.pivots.shape[1]))))
        self.n_blocks = index.blocks
        self.lies = np.zeros((len(index.pivots), index.blocks), bool)  # which blocks a cell's rows lie in
        for c in np.flatnonzero(self.size):
            self.lies[c, index.first[c]:index.first[c] + index.parts[c]] = True
        dealt = spark.sparkContext.broadcast((index.first, index.parts))

        @F.pandas_udf("int")
        def home(c: pd.Series, hashed: pd.Series) -> pd.Series:
            first, parts = dealt.value
            own = c.to_numpy()
            return pd.Series(first[own] + hashed.to_numpy() % parts[own], dtype="int32")

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["c", "cell_id"])
            return pd.DataFrame({"b": [pdf["b"].iloc[0]], "ids": [pdf["cell_id"].tolist()], "cells": [pdf["c"].to_numpy()], "x": [np.stack(pdf["x"].to_numpy()).astype(float).tobytes()]})
        key_t = dict(points.dtypes)["cell_id"]
        homed = placed.select("cell_id", "x", "c", home("c", F.pmod(F.xxhash64("cell_id"), F.lit(1 << 40))).alias("b"))
        self.blocks = cut_lineage(homed.groupBy("b").applyInPandas(pack, f"b int, ids array<{key_t}>, cells array<int>, x binary"))


class _Pairs:
    """Pairs of blocks with the vectors of both, kept by pair: they are written once, and a half-step moves potentials alone."""

    def __init__(self, x: _Cells, y: _Cells):
        self.x, self.y = x, y
        self.have = np.zeros((x.n_blocks, y.n_blocks), bool)

    def hold(self, *kept: np.ndarray) -> None:
        """See that all pairs of blocks with a kept pair of cells (x, y) are there."""
        want = self.have.copy()
        for k in kept:
            want |= (self.x.lies.T.astype(float) @ k.astype(float) @ self.y.lies.astype(float)) > 0
        if (want & ~self.have).any():
            self.have = want
            spark = self.x.blocks.sparkSession
            both = [(int(i), int(j)) for i, j in np.argwhere(want)]
            beside = F.broadcast(spark.createDataFrame(both, "xb int, yb int"))
            n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(both) // PAIRS_PER_TASK))
            side = lambda cells, v: (cells.blocks.select(F.col("b").alias(f"{v}b"), F.col("cells").alias(f"{v}c"), F.col("x").alias(f"{v}x"))
                                     .join(beside, f"{v}b").repartition(n_parts, "xb", "yb"))
            adaptive = spark.conf.get("spark.sql.adaptive.enabled")
            spark.conf.set("spark.sql.adaptive.enabled", "false")  # a checkpoint of an adaptive plan forgets how its rows are dealt
            try:
                self.table = cut_lineage(side(self.x, "x").join(side(self.y, "y").hint("shuffle_hash"), ["xb", "yb"]))
            finally:
                spark.conf.set("spark.sql.adaptive.enabled", adaptive)

    def beside(self, **pots: DataFrame) -> DataFrame:
        """The pairs with potentials, each given as (b, p): ``f`` of the x block, ``g`` of the y block."""
        out = self.table
        for name, pot in pots.items():
            own, other, n = ("xb", "yb", self.y.n_blocks) if name == "f" else ("yb", "xb", self.x.n_blocks)
            spread = pot.select(F.col("b").alias(own), F.col("p").alias(name), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(other))
            out = out.join(spread.hint("shuffle_hash"), ["xb", "yb"])
        return out


def _cost_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * x @ y.T + (y * y).sum(1)[None, :], 0.0)


def _cost_bounds(x: _Cells, y: _Cells) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest cost between rows of two cells."""
    d, r = distances(x.centres, y.centres), x.radius[:, None] + y.radius[None, :]
    return np.maximum(d - r, 0.0) ** 2, (d + r) ** 2


def _coarse(x: _Cells, y: _Cells, eps: float, iters: int) -> np.ndarray:
    """Potentials of the y cells from transport between centres, each weighing its rows; both sides are bounded."""
    keep_x, keep_y = x.size > 0, y.size > 0
    c = distances(x.centres[keep_x], y.centres[keep_y]) ** 2
    la, lb = np.log(x.size[keep_x] / x.n), np.log(y.size[keep_y] / y.n)
    f, g, e = np.zeros(len(la)), np.zeros(len(lb)), max(eps, float(np.ptp(c)) / 8.0)

    def lse(z: np.ndarray, axis: int) -> np.ndarray:
        top = z.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(z - top).sum(axis=axis))
    while True:
        for _ in range(iters):
            last = f
            f = -e * lse((g[None, :] - c) / e + lb[None, :], 1)
            g = -e * lse((f[:, None] - c) / e + la[:, None], 0)
            if np.abs(f - last).max() < ROUGH * e:
                break
        if e <= eps:
            break
        e = max(eps, e / FALL)
    out = np.zeros(len(y.size))
    out[keep_y] = g - eps * np.log(y.n)  # of a single row, where the cell's mass is its rows times 1/n
    return out


def _kept(lo: np.ndarray, hi: np.ndarray, g_lo: np.ndarray, g_hi: np.ndarray, size: np.ndarray, own: np.ndarray, eps: float, loss: float) -> np.ndarray:
    """Whether a pair of cells (own, other) is one that an update of the own rows must compare: the rest adds less than ``loss`` of any row's sum."""
    held = size > 0
    with np.errstate(divide="ignore"):
        rows = np.log(size)[None, :]
    least = ((g_lo[None, :] - hi) / eps + rows)[:, held].max(axis=1, keepdims=True)
    share = np.where(held[None, :], np.exp(np.minimum((g_hi[None, :] - lo) / eps + np.where(held, rows, 0.0) - least, 700.0)), 0.0)
    order = np.argsort(share, axis=1)
    small = np.take_along_axis(share, order, 1).cumsum(axis=1) <= loss
    drop = np.zeros_like(small)
    np.put_along_axis(drop, order, small, 1)
    return ~drop & held[None, :] & (own > 0)[:, None]


def _tiles(own: np.ndarray, other: np.ndarray, kept: np.ndarray) -> Iterator[tuple[slice, slice | np.ndarray]]:
    """Rows of two blocks to compare, given the cell of each, in order: a few own rows, and the other rows of cells kept for them."""
    names, place = np.unique(other, return_inverse=True)
    for at in range(0, len(own), TILE):
        part = own[at:at + TILE]
        cells = np.unique(part)
        met = kept[np.ix_(cells, names)]
        if met.all():
            yield slice(at, at + len(part)), slice(None)
            continue
        starts = np.searchsorted(part, [*cells, cells[-1] + 1])
        for m, i, j in zip(met, starts[:-1], starts[1:]):
            if m.any():
                yield slice(at + int(i), at + int(j)), np.flatnonzero(m[place])


def _sides(batch: pa.RecordBatch, v: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row the cells and the vectors of its block."""
    for c, x in zip(batch.column(f"{v}c"), batch.column(f"{v}x")):
        cells = c.values.to_numpy()
        yield cells, np.frombuffer(x.as_buffer(), float).reshape(len(cells), -1)


def _lse(own: str, other: str, pot: str, kept, eps: float):
    """Per pair of blocks the log of the sum over the other rows, for each own row, as a maximum and a sum beside it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, ((xc, x), (yc, y)) in enumerate(zip(_sides(batch, own), _sides(batch, other))):
                q = batch.column(pot)[r].values.to_numpy()
                m, s = np.full(len(x), -np.inf), np.zeros(len(x))
                for i, j in _tiles(xc, yc, kept.value):
                    e = (q[j][None, :] - _cost_block(x[i], y[j])) / eps
                    m[i] = e.max(axis=1)
                    s[i] = np.exp(e - m[i][:, None]).sum(axis=1)
                if s.any():
                    yield pa.RecordBatch.from_arrays([batch.column(f"{own}b").slice(r, 1), batch.column(f"{other}b").slice(r, 1), pa.array([m]), pa.array([s])], ["b", "part", "m", "s"])
    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    m, s = np.stack(pdf["m"]), np.stack(pdf["s"])
    top = m.max(axis=0)
    first = pdf.iloc[0]
    with np.errstate(invalid="ignore"):  # rows for which none of these blocks is kept
        total = np.where(s > 0, s * np.exp(m - top), 0.0).sum(axis=0)
    return pd.DataFrame({"b": [first["b"]], "part": [int(first["part"]) // 64], "m": [top], "s": [total]})


_PART = "b int, part int, m array<double>, s array<double>"


def _point_half(pairs: _Pairs, to: str, kept: np.ndarray, pot: DataFrame, eps: float, old: DataFrame | None) -> DataFrame:
    """Potentials of the blocks of the side ``to`` given those of the other, (b, p, o), with the ones before as ``o``."""
    other, cells, rest = ("y", pairs.x, pairs.y) if to == "x" else ("x", pairs.y, pairs.x)
    name = "g" if to == "x" else "f"
    held = pot.sparkSession.sparkContext.broadcast(kept)
    part = (pairs.beside(**{name: pot}).select(f"{to}b", f"{to}c", f"{to}x", f"{other}b", f"{other}c", f"{other}x", name)
            .mapInArrow(_lse(to, other, name, held, eps), _PART))
    groups = rest.n_blocks
    while groups > 64:  # partial sums of a block are added in groups of bounded size
        groups = -(-groups // 64)
        part = part.groupBy("b", F.pmod(F.xxhash64("part"), F.lit(groups))).applyInPandas(_merge, _PART)
    part = part.groupBy("b").applyInPandas(_merge, _PART)
    lm = float(np.log(cells.n))
    p = F.transform(F.arrays_zip("m", "s"), lambda z: F.lit(-eps) * (z["m"] + F.log(z["s"]) + F.lit(lm)))
    out = part.select("b", p.alias("p"))
    if old is None:
        return out.withColumn("o", F.lit(None).cast("array<double>"))
    return out.join(old.select("b", F.col("p").alias("o")), "b")


def _ranges(pot: DataFrame, cells: _Cells) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest potential in each cell."""
    lo, hi = np.zeros(len(cells.size)), np.zeros(len(cells.size))
    rows = pot.select("b", "p").join(cells.blocks.select("b", "cells"), "b").select(F.explode(F.arrays_zip(F.col("cells").alias("c"), "p")).alias("z"))
    for r in rows.groupBy("z.c").agg(F.min("z.p").alias("lo"), F.max("z.p").alias("hi")).collect():
        lo[r["c"]], hi[r["c"]] = r["lo"], r["hi"]
    return lo, hi


def _change(pot: DataFrame, eps: float, n: int) -> float:
    """Summed difference of the row masses to 1/n before the update that made ``pot``."""
    off = F.aggregate(F.zip_with("o", "p", lambda o, p: F.abs(F.exp((o - p) / F.lit(eps)) - 1.0)), F.lit(0.0), lambda a, v: a + v)
    return pot.agg(F.sum(off).alias("e")).first()["e"] / n


def sinkhorn_points(x: DataFrame, y: DataFrame, eps: float, iters: int = 1000, tol: float = TOLERANCE, block_rows: int | None = None) -> dict:
    """Dense entropic transport between point sets (cell_id, x) with squared Euclidean cost, uniform marginals.

    Returns potentials f and g as (cell_id, p), the source map ``per_source`` (cell_id, cost, mass, y_bar of
    plan-weighted target means; row mass 1/N is not divided out), the rounds, the error reached and the share of pairs of
    cells that the last round compared. Ids are distinct and neither set is empty.
    """
    xs, ys = _Cells(x, block_rows), _Cells(y, block_rows)
    if not xs.n or not ys.n:
        raise ValueError("both point sets need rows")
    lo, hi = _cost_bounds(xs, ys)
    start = _coarse(xs, ys, eps, 200)
    loss = tol / 10.0
    at = F.array(*[F.lit(float(v)) for v in start])
    g = ys.blocks.select("b", F.transform("cells", lambda c: F.get(at, c)).alias("p"))
    g_lo = g_hi = start
    pairs = _Pairs(xs, ys)
    f, rounds, error = None, 0, float("inf")
    while rounds < iters and error > tol:
        # the pairs are chosen anew after each look at the potentials, and hold for the rounds up to the next
        kept = _kept(lo, hi, g_lo, g_hi, ys.size, xs.size, eps, loss)
        pairs.hold(kept)
        f = cut_lineage(_point_half(pairs, "x", kept, g, eps, f))
        f_lo, f_hi = _ranges(f, xs)
        error = _change(f, eps, xs.n) if rounds else error
        back = _kept(lo.T, hi.T, f_lo, f_hi, xs.size, ys.size, eps, loss)
        pairs.hold(back.T)
        g = _point_half(pairs, "y", back, f, eps, None)
        rounds += 1
        for _ in range(min(POINT_ROUNDS, rounds) - 1 if error > tol else 0):
            f = _point_half(pairs, "x", kept, g, eps, f)
            g = _point_half(pairs, "y", back, f, eps, None)
            rounds += 1
        f, g = cut_lineage(f), cut_lineage(g)
        g_lo, g_hi = _ranges(g, ys)
    kept = _kept(lo, hi, g_lo, g_hi, ys.size, xs.size, eps, loss)
    pairs.hold(kept)
    held = x.sparkSession.sparkContext.broadcast(kept)

    def plan_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, ((xc, xx), (yc, yy)) in enumerate(zip(_sides(batch, "x"), _sides(batch, "y"))):
                fp, gp = batch.column("f")[r].values.to_numpy(), batch.column("g")[r].values.to_numpy()
                for i, j in _tiles(xc, yc, held.value):
                    c = _cost_block(xx[i], yy[j])
                    p = np.exp((fp[i][:, None] + gp[j][None, :] - c) / eps)
                    n = len(p)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("xb")[r].as_py(), np.int32)), pa.array(np.arange(i.start, i.start + n, dtype=np.int32)), pa.array((p * c).sum(1)),
                                                      pa.array(p.sum(1)), pa.array(list(p @ yy[j]), pa.list_(pa.float64()))], ["b", "pos", "cost", "mass", "ybar"])
    dim = xs.centres.shape[1]
    part = pairs.beside(f=f, g=g).select("xb", "xc", "xx", "yc", "yx", "f", "g").mapInArrow(plan_sums, "b int, pos int, cost double, mass double, ybar array<double>")
    per = part.groupBy("b", "pos").agg(F.sum("cost").alias("cost"), F.sum("mass").alias("mass"), sum_vectors("ybar", dim).alias("y_bar"))
    per = xs.blocks.select("b", F.posexplode("ids").alias("pos", "cell_id")).join(per, ["b", "pos"]).select("cell_id", "cost", "mass", "y_bar")

    def unpacked(cells: _Cells, pot: DataFrame) -> DataFrame:
        rows = cells.blocks.select("b", "ids").join(pot.select("b", "p"), "b")
        return rows.select(F.explode(F.arrays_zip(F.col("ids").alias("cell_id"), "p")).alias("z")).select("z.cell_id", "z.p")
    compared = int(kept.sum()) / max(1, int((xs.size > 0).sum() * (ys.size > 0).sum()))
    return {"f": unpacked(xs, f), "g": unpacked(ys, g), "per_source": per, "rounds": rounds, "error": error, "compared": compared}


def sinkhorn_divergence(x: DataFrame, y: DataFrame, eps: float, iters: int = 1000, tol: float = TOLERANCE) -> DataFrame:
    """OT(x, y) - (OT(x, x) + OT(y, y)) / 2, one row."""
    total = [sinkhorn_points(a, b, eps, iters, tol)["per_source"].agg(F.sum("cost").alias("c")).scalar() for a, b in ((x, y), (x, x), (y, y))]
    one = x.sparkSession.range(1)
    return one.select(total[0].alias("ot_xy"), (total[0] - 0.5 * (total[1] + total[2])).alias("divergence"))


def sample_coupling(plan: DataFrame, n: int, seed: int = 0, per_slice: int = 20_000) -> DataFrame:
    """``n`` pairs drawn in proportion to p, with replacement: (draw, i, j).

    Cumulative mass is built per source and then inside the source; draws and mass intervals meet on equal
    slices of the unit interval, so a heavy source is spread over the slices it covers. There are as many
    slices as put about ``per_slice`` draws and pairs on each.
    """
    plan = cut_lineage(plan.select("i", "j", "p"))
    buckets = max(256, (n + plan.count()) // per_slice)
    mass = plan.groupBy("i").agg(F.sum("p").alias("p"))
    outer = ranking.prefix_counts(mass, [], "i", weight="p").select("i", F.col("before").alias("b0"), F.col("total").alias("tot"))
    inner = ranking.prefix_counts(plan, ["i"], "j", weight="p").join(outer, "i")
    lo = (F.col("b0") + F.col("before")) / F.col("tot")
    hi = (F.col("b0") + F.col("before") + F.col("n")) / F.col("tot")
    iv = inner.select("i", "j", lo.alias("lo"), hi.alias("hi"))
    top = F.lit(buckets - 1)
    iv = iv.withColumn("s", F.explode(F.sequence(F.least(F.floor(F.col("lo") * buckets), top), F.least(F.floor(F.col("hi") * buckets), top))))
    d = plan.sparkSession.range(n).select(F.col("id").alias("draw"), hashing.uniform("id", seed=seed).alias("u"))
    d = d.withColumn("s", F.least(F.floor(F.col("u") * buckets), top))
    hit = d.join(iv, "s").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return hit.select("draw", "i", "j")


def barycentric_map(plan: DataFrame, y: DataFrame, dim: int, normalise: bool = False) -> DataFrame:
    """Plan-weighted mean target per source: (i, y_bar). ``normalise`` divides by the row mass."""
    j = plan.join(y.select(F.col("cell_id").alias("j"), F.col("x").alias("_y")), "j")
    s = j.groupBy("i").agg(sum_vectors("_y", dim, F.col("p")).alias("y_bar"), F.sum("p").alias("_m"))
    return s.select("i", F.transform("y_bar", lambda a: a / F.col("_m")).alias("y_bar") if normalise else F.col("y_bar"))


def coupling_loss(bary: DataFrame, x: DataFrame) -> DataFrame:
    """Mean distance of each source row to its mapped target."""
    j = bary.join(x.select(F.col("cell_id").alias("i"), "x"), "i")
    return j.agg(F.avg(norm(sub("y_bar", "x"))).alias("loss"))


def interpolate(bary: DataFrame, x: DataFrame, t: float | Column) -> DataFrame:
    """(1 - t) x + t y_bar for a number or a column t."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    j = bary.join(x.select(F.col("cell_id").alias("i"), "x"), "i").withColumn("_t", t)
    return j.select("i", F.zip_with("x", "y_bar", lambda a, b: (1.0 - F.col("_t")) * a + F.col("_t") * b).alias("x_t"))


def _pair_sums(dim: int, keys: list[str]):
    """Sums of [1, x0, x1] products per key and task, from Arrow batches; a task with very many keys hands on what it has."""
    width = 1 + 2 * dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            names = [pa.array([k[c] for k in held], kinds[c]) for c in range(len(keys))]
            made = pa.RecordBatch.from_arrays([*names, pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))], [*keys, "m"])
            held.clear()
            return made

        kinds = []
        for batch in batches:
            kinds = [f.type for f in batch.schema][2:]
            if not batch.num_rows:
                continue
            sides = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in (0, 1)]
            z = np.hstack([np.ones((batch.num_rows, 1)), *sides])
            if keys:
                names = batch.select(list(keys)).to_pandas()
                parts = [(k, z[at]) for k, at in names.groupby(list(keys), sort=False, dropna=False).indices.items()]
            else:
                parts = [((), z)]
            for key, rows in parts:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                if key not in held and (len(held) + 1) * width * width > HELD_SUMS:
                    yield out()
                held[key] = held.get(key, 0.0) + rows.T @ rows
        if held:
            yield out()
    return run


def moment_pairs(pairs: DataFrame, x: DataFrame, y: DataFrame, dim: int, keys: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Few weighted pairs in place of ``pairs``: (pairs with weight, x, y), 4 * dim rows a key.

    Together they have the count, the mean and all second moments of the coupled (x0, x1), so every sum of products of what
    depends linearly on them, as both columns of :func:`bridge_targets` do at a given t, is the same as over all pairs.
    They lie on the principal axes around the mean.
    """
    keys, both = list(keys), 2 * dim
    j = (pairs.join(x.select(F.col("cell_id").alias("i"), F.col("x").alias("_x0")), "i")
         .join(y.select(F.col("cell_id").alias("j"), F.col("x").alias("_x1")), "j").select("_x0", "_x1", *keys))
    kinds = dict(pairs.dtypes)
    part = j.mapInArrow(_pair_sums(dim, keys), ", ".join([*[f"{k} {kinds[k]}" for k in keys], "m array<double>"]))
    summed = part.select(*keys, F.posexplode("m").alias("pos", "val")).groupBy(*keys, "pos").agg(F.sum("val").alias("val"))
    packed = summed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("e")).select(*keys, F.col("e.val").alias("m"))

    @F.pandas_udf("array<struct<weight:double,x0:array<double>,x1:array<double>>>")
    def spread(m: pd.Series) -> pd.Series:
        out = []
        for sums in m:
            g = np.asarray(sums, dtype=float).reshape(1 + both, 1 + both)
            n, mean = g[0, 0], g[0, 1:] / g[0, 0]
            vals, vecs = np.linalg.eigh(g[1:, 1:] / n - np.outer(mean, mean))
            step = (vecs * np.sqrt(both * np.maximum(vals, 0.0))).T
            out.append([{"weight": n / (2 * both), "x0": z[:dim], "x1": z[dim:]} for z in np.concatenate([mean + step, mean - step])])
        return pd.Series(out)
    few = packed.where(F.size("m") == (1 + both) ** 2).select(*keys, F.posexplode(spread("m")).alias("_p", "_z"))
    few = cut_lineage(few.select(*keys, F.xxhash64("_p", *keys).alias("i"), "_z.weight", "_z.x0", "_z.x1"))
    return (few.select("i", F.col("i").alias("j"), "weight", *keys), few.select(F.col("i").alias("cell_id"), F.col("x0").alias("x")),
            few.select(F.col("i").alias("cell_id"), F.col("x1").alias("x")))


def bridge_targets(pairs: DataFrame, x: DataFrame, y: DataFrame, t_values: list[float]) -> DataFrame:
    """Regression table of the bridge: (pair columns, direction, t, x, v).

    x = (1-t) x0 + t x1; v is the remaining way to the end point, over (1 - t + 1e-6) forward, (t + 1e-6) backward.
    """
    j = (pairs.join(x.select(F.col("cell_id").alias("i"), F.col("x").alias("x0")), "i")
         .join(y.select(F.col("cell_id").alias("j"), F.col("x").alias("x1")), "j")
         .withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in t_values]))))
    j = j.withColumn("xt", F.zip_with("x0", "x1", lambda a, b: (1.0 - F.col("t")) * a + F.col("t") * b))
    fwd = F.struct(F.lit("forward").alias("direction"), F.zip_with("x1", "xt", lambda a, b: (a - b) / (1.0 - F.col("t") + 1e-6)).alias("v"))
    bwd = F.struct(F.lit("backward").alias("direction"), F.zip_with("x0", "xt", lambda a, b: (a - b) / (F.col("t") + 1e-6)).alias("v"))
    out = j.withColumn("_d", F.explode(F.array(fwd, bwd)))
    return out.select(*pairs.columns, "_d.direction", "t", F.col("xt").alias("x"), "_d.v")
