"""Nearest rows by counts, kernel sums, replicate draws, pivots: against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisflow.operators import kernels, nearest, neighbors, windows
from axisflow.operators.pivots import PivotIndex, distances


def frame(spark, t, value=None, **more):
    n = len(t)
    cols = {"cell_id": range(n), "t": t, "value": value if value is not None else range(n), **more}
    return spark.createDataFrame([(int(a), None if b is None else float(b), float(c), *[str(x) for x in rest]) for a, b, c, *rest in zip(*cols.values())],
                                 "cell_id long, t double, value double" + "".join(f", {k} string" for k in more))


def plain_nearest(t, c, m):
    order = sorted((abs(x - c), i) for i, x in enumerate(t) if x is not None)
    return [i for _, i in order[:m]]


@pytest.mark.parametrize("kind", ["even", "skewed", "ties", "few", "constant"])
def test_nearest_rows_equal_a_full_sort(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "BINS", 16)
    monkeypatch.setattr(nearest, "CROWDED", 1)
    rng = np.random.default_rng(3)
    t = {"even": rng.random(3000), "skewed": np.concatenate([rng.random(2990) * 1e-4, rng.random(10)]), "ties": np.round(rng.random(3000), 1),
         "few": rng.random(4), "constant": np.full(50, 0.5)}[kind]
    grid = windows.linspace(0.0, 1.0, 7)
    points = spark.createDataFrame([(i, g) for i, g in enumerate(grid)], "t_idx int, _c double")
    got = {}
    for r in nearest.nearest_rows(frame(spark, t), points, 6).collect():
        got.setdefault(r["t_idx"], []).append((r["_rk"], r["cell_id"]))
    assert {i: [c for _, c in sorted(v)] for i, v in got.items()} == {i: plain_nearest(t, g, 6) for i, g in enumerate(grid)}


def test_few_rows_are_looked_at_per_point(spark):
    t = np.random.default_rng(4).random(20_000)
    rows = frame(spark, t)
    points = windows._grid_points(rows, windows.linspace(0.0, 1.0, 30), [])
    found, lo, hi, cells = nearest.bounded_points(rows, points, 20, [])
    touched = nearest.within(rows, found.select("t_idx", "_c", "_r"), [], lo, hi, cells).groupBy("t_idx").count().agg(F.max("count")).first()[0]
    assert 20 <= touched <= 60


def test_nearest_rows_by_key_with_nulls(spark):
    rows = frame(spark, [0.1, None, 0.4, 0.9, 0.2, 0.3], k=["a", "a", "a", "b", "b", "b"])
    got = windows.nearest_m_mean(rows, bins=2, m=2, keys=["k"]).collect()
    assert {(r["k"], r["t_idx"]): r["mean"] for r in got} == {("a", 0): 1.0, ("a", 1): 1.0, ("b", 0): 4.5, ("b", 1): 4.0}
    assert windows.nearest_m_mean(rows.limit(0), bins=2, m=2).count() == 0


def test_replicate_counts_are_poisson():
    c = kernels.poisson_counts(np.arange(20_000), 30)
    assert abs(c.mean() - 1.0) < 0.01 and abs(c.var() - 1.0) < 0.02
    r = np.corrcoef(c.T) - np.eye(30)
    assert np.abs(r).max() < 0.05 and abs(np.corrcoef(c[:-1, 0], c[1:, 0])[0, 1]) < 0.03
    assert (kernels.poisson_counts(np.arange(50), 5, seed=1) != kernels.poisson_counts(np.arange(50), 5, seed=2)).any()


def test_kernel_sums_equal_numpy(spark):
    rng = np.random.default_rng(6)
    t, v, u = rng.random(300), rng.normal(size=300), rng.random(300)
    rows = spark.createDataFrame([(i, float(a), float(b), float(c), "xy"[i % 2]) for i, (a, b, c) in enumerate(zip(t, v, u))] + [(900, None, 1.0, 1.0, "x"), (901, 0.5, 2.0, None, "x")],
                                 "cell_id long, t double, value double, u double, rep string").repartition(4)
    grid, widths = [0.2, 0.5, 0.8], [0.05, 0.2]
    got = {(r["rep"], r["_h"], r["_rep"], r["t_idx"]): r for r in kernels.kernel_sums(rows, grid, widths, weight="u", keys=["rep"], n_boot=3, seed=5).collect()}
    assert len(got) == 2 * 2 * 4 * 3
    counts = np.hstack([np.ones((300, 1)), kernels.poisson_counts(np.arange(300), 3, 5)])
    for key in "xy":
        on = np.arange(300) % 2 == "xy".index(key)
        for h, width in enumerate(widths):
            k = np.exp(-0.5 * ((np.array(grid) - t[on, None]) / width) ** 2) * u[on, None]
            for rep in range(4):
                m = counts[on, rep][:, None]
                for i in range(3):
                    r = got[(key, h, rep - 1, i)]
                    assert np.allclose([r["sw"], r["sq"], r["s_value"]], [(m * k).sum(0)[i], (m * k * k).sum(0)[i], (m * k * v[on, None]).sum(0)[i]])


def test_many_keys_are_handed_on(spark, monkeypatch):
    rows = spark.range(200).select(F.col("id").alias("cell_id"), (F.col("id") / 200).alias("t"), F.lit(1.0).alias("value"), (F.col("id") % 40).alias("k"))
    monkeypatch.setattr(kernels, "HELD", 30)
    out = windows.kernel_smooth(rows, [0.2, 0.6], 0.3, keys=["k"]).collect()
    assert len(out) == 80 and all(r["mean"] == pytest.approx(1.0) for r in out)


def test_pivot_index_keeps_every_neighbour():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(400, 4)) * 0.1 + c for c in rng.normal(size=(5, 4)) * 3])
    index = PivotIndex(x[rng.choice(len(x), 60, replace=False)])
    own, d = index.nearest(x)
    assert np.allclose(d, distances(x, index.pivots)[np.arange(len(x)), own])
    count = np.bincount(own, minlength=60)
    lo = np.array([d[own == p].min() if count[p] else np.inf for p in range(60)])
    hi = np.array([d[own == p].max() if count[p] else -np.inf for p in range(60)])
    cover = np.array([np.sort(d[own == p])[4] if count[p] >= 5 else np.inf for p in range(60)])
    index.bound(count, lo, hi, cover)
    q = rng.normal(size=(200, 4)) * 3
    visited = index.visit(q)
    for i, p in enumerate(visited):
        true = np.argsort(((x - q[i]) ** 2).sum(1))[:5]
        assert set(own[true]) <= set(p)
    assert np.mean([len(p) for p in visited]) < 40  # pivots were dropped
    for p in index.probe(q, 2, 100):
        assert count[p].sum() >= 100 and len(p) >= 2


def test_pivots_grow_with_the_rows():
    from axisflow.operators.pivots import PIVOT_BYTES, wanted_pivots
    assert wanted_pivots(10_000, 64) == 66 and wanted_pivots(100_000_000, 64) == 6666
    assert wanted_pivots(10**15, 64) * 64 * 8 <= PIVOT_BYTES


@pytest.mark.parametrize("clustered", [True, False])
def test_approximate_neighbours_by_codes(spark, clustered):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)) * (0.2 if clustered else 1.0) + (rng.normal(size=(10, 16))[rng.integers(0, 10, 1500)] * 3 if clustered else 0)
    x[1200:1230] = x[0]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, x array<double>")
    exact, approx = neighbors.knn(df, 10), neighbors.knn_approx(df, 10)
    assert neighbors.recall(exact, approx).first()["recall"] >= 0.9
    assert approx.groupBy("src").count().where("count <> 10").count() == 0
    few = neighbors.knn_approx(df.limit(3), 10)
    assert few.count() == 6 and neighbors.knn(df.limit(0), 3).count() == 0


def test_neighbour_search_does_not_broadcast_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "cell_id long, x array<double>").write.parquet(str(tmp_path / "v"))
    out = neighbors.knn(spark.read.parquet(str(tmp_path / "v")), 5, block_rows=400)
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= 1  # the pairs of blocks
    got = {(r["src"], r["rnk"]): r["dst"] for r in out.where("src % 100 = 0").collect()}
    for i in range(0, 3000, 100):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [got[i, r] for r in range(1, 6)] == list(np.argsort(d, kind="stable")[:5])


def test_blocks_hold_a_bounded_number_of_rows():
    index = PivotIndex(np.arange(6.0)[:, None])
    n = np.array([3, 2, 9, 1, 1, 5])
    index.bound(n, np.zeros(6), np.ones(6), np.ones(6)).blocked(5)
    held = np.zeros(index.blocks)
    for p, m in enumerate(n):
        np.add.at(held, index.home(np.full(m, p), np.arange(m)), 1)
    assert held.sum() == n.sum() and held.max() <= 5
    assert set(index.blocks_of(np.array([2]))) == {index.first[2], index.first[2] + 1}


def test_proximal_results_without_pairs(spark):
    from axisflow.operators import graph
    rng = np.random.default_rng(5)
    p = spark.createDataFrame([(i, "ab"[i % 2], int(x)) for i, x in enumerate(rng.integers(-60, 60, 300))], "point_id long, chrom string, pos long")
    i = spark.createDataFrame([(i, "ab"[i % 2], int(x)) for i, x in enumerate(rng.integers(-90, 90, 60))] + [(99, None, 1)], "interval_id long, chrom string, centre long")
    for reach in (0, 4, 7):
        pairs = graph.proximal_join(p, i, reach)
        want = pairs.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.sum("offset").alias("total"), F.min("interval_id").alias("first"))
        got = graph.proximal_join(p, i, reach, summary=True)
        assert "interval_id" not in got.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        net = p.select(F.concat(F.lit("s"), (F.col("point_id") % 7).cast("string")).alias("source"), F.col("point_id").alias("target"))
        assert sorted(graph.regulon_peaks(net, i, p, reach).collect()) == sorted(graph.regulon_peaks(net, pairs, p).collect())


def test_silhouette_groups_are_pairs_of_blocks(spark):
    from axisflow.operators import clustering
    rng = np.random.default_rng(8)
    x, l = rng.normal(size=(700, 3)), rng.integers(0, 3, 700)
    df = spark.createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, l))], "cell_id long, x array<double>, l int")
    out = clustering.silhouette(df, "l", 3)
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()  # whole packed blocks by the batch
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    per = np.stack([d[:, l == c].sum(1) for c in range(3)], 1)
    size = np.bincount(l)
    a = per[np.arange(700), l] / (size[l] - 1)
    b = np.where(np.arange(3)[None] == l[:, None], np.inf, per / size).min(1)
    want = ((b - a) / np.maximum(a, b)).mean()
    for got in (out.first(), clustering.silhouette(df, "l", 3, block_rows=64).first()):
        assert got["silhouette"] == pytest.approx(want) and got["n"] == 700


def test_pullback_totals_without_the_product(spark, monkeypatch):
    from axisflow.operators import grn
    monkeypatch.setattr(grn, "TOTAL_ROWS", 7)
    rng = np.random.default_rng(9)
    ops = spark.createDataFrame([(b, [float(a) for a in rng.normal(size=4)]) for b in range(3)], "bin int, j array<double>")
    dec = spark.createDataFrame([(g, [float(a) for a in rng.normal(size=2)]) for g in range(25)], "gene long, d array<double>")
    enc = spark.createDataFrame([(g, [float(a) for a in rng.normal(size=2)]) for g in range(9)], "tf long, e array<double>")
    full = grn.pullback(ops, dec, enc, 2)
    want = {(r["bin"], r["gene"]): r["t"] for r in full.groupBy("bin", "gene").agg(F.sum(F.abs("v")).alias("t")).collect()}
    got = {(r["bin"], r["gene"]): r["total"] for r in grn.pullback(ops, dec, enc, 2, total=True).collect()}
    assert len(got) == 75 and all(got[k] == pytest.approx(v) for k, v in want.items())
