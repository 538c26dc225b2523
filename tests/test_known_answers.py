"""Known answers: identities, contracts and brute-force comparisons on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisflow.functions import ranking
from axisflow.functions.special import hypergeometric_tail, log_gamma, t_two_sided
from axisflow.operators import agreement, clustering, field, fourier, graph, grn, neighbors, nulls, prep, regimes, regulators, spectra, transport, windows
from axisflow.sources import assemble, readers, writers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "cell_id long, x array<double>")


# ---- ranks and quantiles ----
def test_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=400), np.full(300, 0.25)])  # a third of all rows share one value
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    got = ranking.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    assert np.allclose(tuple(got), np.quantile(v, [0.1, 0.5, 0.9]))


def test_row_positions_are_a_permutation_under_ties(spark):
    v = [1.0] * 300 + [float(i % 7) for i in range(200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v double")
    pos = {r["id"]: r["pos"] for r in ranking.row_positions(df, "v", "id").collect()}
    want = {i: p for p, i in enumerate(sorted(range(len(v)), key=lambda i: (v[i], i)))}
    assert pos == want


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", 2.0)], "k string, v double")
    assert rows(ranking.average_ranks(df, {"v": "r"}, ["k"]).select("k", "v", "r"), "k", "v") == [("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 5.0, 3.0), ("b", 2.0, 1.0)]


def test_special_functions(spark):
    one = spark.range(1)
    got = one.select(log_gamma(F.lit(7.5)), t_two_sided(F.lit(2.228138852), F.lit(10.0)), hypergeometric_tail(F.lit(3), F.lit(5), F.lit(8), F.lit(20)),
                     hypergeometric_tail(F.lit(1), F.lit(5), F.lit(8), F.lit(20)), hypergeometric_tail(F.lit(0), F.lit(5), F.lit(8), F.lit(20))).first()
    tail = lambda k: sum(math.comb(8, x) * math.comb(12, 5 - x) for x in range(k, 6)) / math.comb(20, 5)
    assert np.allclose(tuple(got), [math.lgamma(7.5), 0.05, tail(3), tail(1), 1.0], atol=1e-8)


# ---- neighbours ----
def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (round(d[i, j], 9), j))[:k]
        out += [(i, j, r + 1) for r, j in enumerate(order)]
    return sorted(out)


def test_knn_exact_with_copies(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(120, 5)), np.tile([[0.5] * 5], (60, 1)), 100 + rng.normal(size=(30, 5))])
    got = rows(neighbors.knn(vectors(spark, x), 7, block_rows=16).select("src", "dst", "rnk"), "src", "dst")
    assert sorted(got) == brute(x, 7)


def test_knn_between_tables_and_recall(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 4)), rng.normal(size=(60, 4))
    got = {}
    for s, d, dist, r in rows(neighbors.knn(vectors(spark, b), 3, queries=vectors(spark, a)), "src", "rnk"):
        got.setdefault(s, []).append(d)
    d = ((a[:, None] - b[None]) ** 2).sum(-1)
    assert got == {i: list(np.argsort(d[i])[:3]) for i in range(40)}
    exact = neighbors.knn(vectors(spark, b), 5)
    assert neighbors.recall(exact, exact).first()[0] == 1.0


def test_confidence_is_within_unit_interval(spark):
    x = np.random.default_rng(4).normal(size=(64, 16))
    v = vectors(spark, x)
    out = neighbors.knn_interpolate(neighbors.knn(v, 8), v.withColumnRenamed("x", "v"), 16)
    lo, hi = out.agg(F.min("conf"), F.max("conf")).first()
    assert 0 <= lo <= hi <= 1


def test_proximal_join_counts_each_pair_once_and_includes_ends(spark):
    p = spark.createDataFrame([(1, "c", 1000), (2, "c", 50), (3, "d", 1000)], "point_id long, chrom string, pos long")
    i = spark.createDataFrame([(10, "c", 1100), (11, "c", 900), (12, "c", 1101), (13, "c", 1000), (14, "d", 2000)], "interval_id long, chrom string, centre long")
    assert rows(graph.proximal_join(p, i, 100).select("point_id", "interval_id"), "point_id", "interval_id") == [(1, 10), (1, 11), (1, 13)]


def test_graph_pseudotime_on_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "src long, dst long, dist double")
    got = rows(graph.graph_pseudotime(e, F.lit(0)).select("cell_id", F.round("t", 4)), "cell_id")
    assert [t for _, t in got] == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def test_absorption_sums_to_one(spark):
    axis = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 1.0), (3, 1.0)], "cell_id long, t double")
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 3.0), (1, 3, 1.0), (2, 0, 1.0)], "src long, dst long, w double")
    term = spark.createDataFrame([(2, "a"), (3, "b")], "cell_id long, branch string")
    p = {(c, b): v for c, b, v in rows(graph.absorb_probabilities(e, axis, term), "cell_id", "branch")}
    assert p[(0, "a")] == pytest.approx(0.75) and p[(0, "b")] == pytest.approx(0.25)


# ---- field ----
def test_local_linear_operator_recovers_a_linear_map(spark):
    rng = np.random.default_rng(5)
    a = np.array([[-1.0, 0.3], [0.0, 0.5]])
    x = rng.normal(size=(400, 2))
    data = [(i, float(rng.random()), [float(v) for v in r], [float(v) for v in a @ r]) for i, r in enumerate(x)]
    cells = spark.createDataFrame(data, "cell_id long, t double, x array<double>, v array<double>")
    for (j,) in field.local_linear_operator(cells, [0.3, 0.7], 0.2, 2, 1e-9).select("j").collect():
        assert np.allclose(j, a.ravel(), atol=1e-6)


def test_time_gate_rejects_unknown_mode():
    with pytest.raises(ValueError):
        field.time_gate("sideways")


# ---- windows ----
def test_windows_are_closed_at_both_ends(spark):
    width, step = windows.window_geometry(5, 0.5)
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, step), (3, width)], "cell_id long, t double")
    got = {}
    for c, i in rows(windows.overlapping_windows(df, 5, 0.5).select("cell_id", "t_idx"), "cell_id", "t_idx"):
        got.setdefault(c, []).append(i)
    want = {c: [i for i in range(5) if i * step <= t <= i * step + width] for c, t in [(0, 0.0), (1, 1.0), (2, step), (3, width)]}
    assert got == {c: w for c, w in want.items() if w}


def test_kernel_of_a_constant_is_the_constant(spark):
    df = spark.createDataFrame([(i, i / 99, 3.5) for i in range(100)], "cell_id long, t double, value double")
    out = windows.kernel_smooth(df, [0.2, 0.5], 0.1).collect()
    assert all(r["mean"] == pytest.approx(3.5) and 1 <= r["n_eff"] <= 100 for r in out)


def test_gaussian_filter_keeps_a_constant_and_mirrors(spark):
    c = spark.createDataFrame([(i, 2.0) for i in range(6)], "t_idx int, v double")
    for edge in (True, False):
        assert all(r["smooth"] == pytest.approx(2.0) for r in windows.gaussian_filter(c, "v", 6, 3.0, repeat_edge=edge).collect())


def test_fate_bins_fill_empty_bins(spark):
    df = spark.createDataFrame([(0.05, 1.0, 1.0), (0.85, 3.0, 1.0)], "t double, value double, w double")
    got = [r["mean"] for r in windows.fate_bins(df, 10).orderBy("t_idx").collect()]
    assert got[0] == pytest.approx(1.0) and got[4] == pytest.approx(2.0) and got[9] == pytest.approx(3.0)


def test_interior_peak_flags_boundary_and_returns_null_when_nothing_is_valid(spark):
    c = spark.createDataFrame([(0, 0.02, 9.0, 99.0), (1, 0.5, 5.0, 99.0), (2, 0.7, 4.0, 10.0)], "t_idx int, t double, v double, n_eff double")
    p = windows.interior_peak(c, "v").first()
    assert (p["t"], p["n_valid"], p["boundary_peak"]) == (0.5, 1, True)
    none = windows.interior_peak(c, "v", n_eff_min=1e6).first()
    assert none["t"] is None and none["n_valid"] == 0


def test_rolling_mean_across_block_edges(spark):
    v = [float((i * 37) % 11) for i in range(95)]
    df = spark.createDataFrame([(i, i / 100, x) for i, x in enumerate(v)], "cell_id long, t double, value double")
    got = [r["smooth"] for r in windows.rolling_mean(df, 7, block=10).orderBy("cell_id").collect()]
    assert np.allclose(got, [np.mean(v[max(0, i - 3):i + 4]) for i in range(95)])


def test_first_crossing_interpolates(spark):
    c = spark.createDataFrame([(0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 0.5)], "t_idx int, t double, a double, b double")
    assert windows.first_crossing(c, "a", "b").first()[0] == pytest.approx(2 / 3)


# ---- spectra ----
def test_linear_operator_metrics(spark):
    ops = spark.createDataFrame([(0, [-1.0, 0.0, 0.0, 0.5])], "cell_id long, j array<double>")
    r = spectra.spectral_metrics(spectra.operator_spectrum(ops, 2), 0.1).first()
    assert (r["lambda_max"], r["lambda_min"], r["plasticity"], r["stable_dim"]) == pytest.approx((0.5, -1.0, 0.0, 1.0))


def test_semi_nmf_recovers_a_low_rank_sequence(spark):
    rng = np.random.default_rng(6)
    w, h = np.abs(rng.normal(size=(40, 2))), rng.normal(size=(2, 9))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(w @ h)], "t_idx int, m array<double>")
    fit, hh, err = spectra.semi_nmf(df, 2, 9, iters=40, restarts=3)
    assert err < 0.15 * np.linalg.norm(w @ h)
    assert min(min(r["w"]) for r in fit.collect()) >= 0


def test_svd_modes_match_numpy(spark):
    m = np.random.default_rng(7).normal(size=(6, 50))
    df = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(m.T)], "col int, m array<double>")
    out, u, s = spectra.svd_modes(df, 6, 2)
    assert np.allclose(s, np.linalg.svd(m)[1])
    v = np.array([r["v"] for r in out.orderBy("col").collect()])
    assert np.allclose(v.T @ v, np.eye(2), atol=1e-9)


def test_dft_round_trip_and_parseval(spark):
    x = np.random.default_rng(8).normal(size=(3, 16))
    z = fourier.dft(vectors(spark, x))
    back = np.array([r["x_back"] for r in fourier.idft(z, 16).orderBy("cell_id").collect()])
    assert np.allclose(back, x)


# ---- transport ----
def plain_sinkhorn(c, eps, rounds=5000):
    f, g = np.zeros(c.shape[0]), np.zeros(c.shape[1])
    lse = lambda z, axis: np.log(np.exp(z - z.max(axis, keepdims=True)).sum(axis)) + z.max(axis)
    for _ in range(rounds):
        f = -eps * (lse((g[None] - c) / eps, 1) + np.log(len(f)))
        g = -eps * (lse((f[:, None] - c) / eps, 0) + np.log(len(g)))
    return np.exp((f[:, None] + g[None] - c) / eps)


def test_sinkhorn_reaches_its_tolerance(spark):
    c = np.abs(np.subtract.outer(np.arange(12), np.arange(9) * 1.4)) ** 1.5 * (1 + np.random.default_rng(1).random((12, 9)))
    cost = spark.createDataFrame([(i, j, float(c[i, j])) for i in range(12) for j in range(9)], "i long, j long, c double")
    done = transport.sinkhorn(cost, 20.0, tol=1e-8)
    assert done["error"] <= 1e-8
    got = np.zeros((12, 9))
    for r in done["plan"].collect():
        got[r["i"], r["j"]] = r["p"]
    assert np.abs(got.sum(1) - 1 / 12).sum() < 1e-7 and np.abs(got.sum(0) - 1 / 9).sum() < 1e-7
    assert np.allclose(got, plain_sinkhorn(c, 20.0, 500), atol=1e-7)
    assert abs(done["g"].agg(F.avg("p")).first()[0]) < 1e-9
    assert transport.sinkhorn(cost.limit(0), 0.5)["plan"].count() == 0


def test_point_sinkhorn_drops_far_cells_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(transport, "CELL_ROWS", 8)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(4, 3)) * 6
    a, b = centres[np.arange(60) % 4] + rng.normal(size=(60, 3)) * 0.3, centres[np.arange(48) % 4] + rng.normal(size=(48, 3)) * 0.3
    want = plain_sinkhorn(((a[:, None] - b[None]) ** 2).sum(2), 2.0, 2_000)
    done = transport.sinkhorn_points(vectors(spark, a), vectors(spark, b), 2.0, tol=1e-5, block_rows=8)
    per = {r["cell_id"]: r for r in done["per_source"].collect()}
    assert done["error"] <= 1e-5 and done["compared"] < 1.0
    assert np.allclose([per[i]["mass"] for i in range(60)], 1 / 60, atol=1e-5)
    assert np.allclose([per[i]["y_bar"] for i in range(60)], want @ b, atol=1e-3)


def test_point_sinkhorn_half_steps_move_no_vectors(spark):
    rng = np.random.default_rng(4)
    a, b = (transport._Cells(vectors(spark, rng.normal(size=(n, 3))), 8) for n in (40, 30))
    pairs = transport._Pairs(a, b)
    pairs.hold(np.ones((len(a.size), len(b.size)), bool))
    table, pot = pairs.table, b.blocks.select("b", F.transform("cells", lambda _: F.lit(0.0)).alias("p"))
    pairs.hold(np.ones((len(a.size), len(b.size)), bool))
    assert pairs.table is table
    step = pairs.beside(g=pot)
    assert step.count() == a.n_blocks * b.n_blocks
    assert step._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_divergence_of_a_set_from_itself(spark):
    a = np.random.default_rng(9).normal(size=(9, 3))
    assert transport.sinkhorn_divergence(vectors(spark, a), vectors(spark, a), 0.5, iters=3).first()["divergence"] == pytest.approx(0.0, abs=1e-9)


def test_coupling_samples_follow_the_mass(spark):
    plan = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.0), (1, 0, 0.25), (1, 1, 0.25)], "i long, j long, p double")
    got = {(i, j): n for i, j, n in rows(transport.sample_coupling(plan, 4000).groupBy("i", "j").count(), "i", "j")}
    assert sum(got.values()) == 4000 and (0, 1) not in got
    assert abs(got[(0, 0)] / 4000 - 0.5) < 0.05


# ---- regulators and operators on genes ----
def test_soft_threshold_shrinks_and_masks(spark):
    g = spark.createDataFrame([(0, "a", "x", 0.5), (0, "a", "y", -0.3), (0, "b", "x", 0.01)], "bin int, tf string, gene string, v double")
    mask = spark.createDataFrame([("a", "x"), ("a", "y")], "tf string, gene string")
    got = {r["gene"]: r["v"] for r in grn.soft_threshold(g, 0.1, mask).collect()}
    assert got == pytest.approx({"x": 0.45, "y": -0.25})


def test_pullback_restriction_equals_slice_of_the_full_product(spark):
    rng = np.random.default_rng(10)
    d, e, j = rng.normal(size=(50, 5)), rng.normal(size=(5, 50)), rng.normal(size=(10, 5, 5))
    ops = spark.createDataFrame([(b, [float(v) for v in m.ravel()]) for b, m in enumerate(j)], "bin int, j array<double>")
    dec = spark.createDataFrame([(g, [float(v) for v in r]) for g, r in enumerate(d)], "gene int, d array<double>")
    enc = spark.createDataFrame([(g, [float(v) for v in r]) for g, r in enumerate(e.T)], "tf int, e array<double>")
    tfs = spark.createDataFrame([(0,), (5,), (10,)], "tf int")
    full = np.einsum("gi,bij,jt->btg", d, j, e)
    got = grn.pullback(ops, dec, enc, 5, tfs).collect()
    assert len(got) == 10 * 3 * 50
    assert all(abs(r["v"] - full[r["bin"], r["tf"], r["gene"]]) < 1e-9 for r in got)
    pairs = spark.createDataFrame([(0, 1), (5, 7)], "tf int, gene int")
    few = grn.pullback(ops, dec, enc, 5, tfs, pairs=pairs).collect()
    assert len(few) == 20 and all(abs(r["v"] - full[r["bin"], r["tf"], r["gene"]]) < 1e-9 for r in few)


def test_co_instability_divides_by_sensitive_points(spark):
    track = spark.createDataFrame([(0, "a", 1.0), (0, "b", -2.0), (1, "a", 3.0), (1, "b", 1.0), (2, "a", 9.0), (2, "b", 9.0)], "t_idx int, feature string, score double")
    lam = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, -1.0)], "t_idx int, lam double")
    assert rows(regulators.co_instability_edges(track, lam), "source") == [("a", "b", 1.0)]


# ---- regimes ----
def test_regime_rows_and_statistics(spark):
    data = [(0, -0.5, -0.5, 0.2, 5.0), (1, 0.01, -0.3, 0.5, 3.0), (2, 0.5, -0.2, 0.3, 2.0), (3, -0.2, -2.0, 0.1, 8.0), (4, -0.3, -0.4, 0.1, 5.0)]
    m = spark.createDataFrame(data, "cell_id long, lambda_max double, lambda_min double, plasticity double, stable_dim double")
    c = regimes.classify_regime(m)
    assert [r["regime"] for r in c.orderBy("cell_id").collect()] == ["stable", "plastic", "unstable", "deeply_stable", "stable"]
    st = {r["regime"]: r for r in regimes.regime_stats(c).collect()}
    assert st["stable"]["n"] == 2 and st["stable"]["lambda_max_mean"] == pytest.approx(-0.4) and st["plastic"]["plasticity_mean"] == pytest.approx(0.5)
    assert all(0 <= r["confidence"] <= 1 for r in regimes.regime_confidence(c).collect())


def test_ari_nmi_bounds(spark):
    df = spark.createDataFrame([(i % 3, (i % 3) + 5, i % 2) for i in range(60)], "a int, b int, c int")
    same = clustering.ari_nmi(df, "a", "b").first()
    assert tuple(same) == pytest.approx((1.0, 1.0))
    assert abs(clustering.ari_nmi(df, "a", "c").first()["nmi"]) < 1e-9


# ---- nulls and agreement ----
def test_identical_and_disjoint_rankings(spark):
    data = [(m, r + 1, f"{p}{r}") for m, p in (("x", "g"), ("y", "g"), ("z", "h")) for r in range(200)]
    df = spark.createDataFrame(data, "method string, rank int, feature string")
    got = {(a, b): j for a, b, j in rows(agreement.ranking_overlap(df, [50]).select("m1", "m2", "jaccard"), "m1", "m2")}
    assert got == {("x", "y"): 1.0, ("x", "z"): 0.0, ("y", "z"): 0.0}


def test_peak_overlap_of_equal_and_distant_peaks(spark):
    same = spark.createDataFrame([(0, 0.5), (1, 0.5)], "run int, peak double")
    far = spark.createDataFrame([(0, 0.05), (1, 0.95)], "run int, peak double")
    assert agreement.peak_overlap(same, 0.05).first()["overlap_frac"] == 1.0
    assert agreement.peak_overlap(far, 0.05).first()["overlap_frac"] == 0.0


def test_poisson_weights_have_unit_mean(spark):
    from axisflow.functions.hashing import poisson_one
    m, v = spark.range(20000).agg(F.avg(poisson_one("id")), F.var_pop(poisson_one("id"))).first()
    assert abs(m - 1) < 0.03 and abs(v - 1) < 0.05


def test_block_permutation_keeps_the_tail_and_all_values(spark):
    c = spark.createDataFrame([(i, float(i)) for i in range(23)], "t_idx int, v double")
    out = nulls.block_permutation(c, 23, 5, 3)
    for rep in range(3):
        got = {r["t_idx"]: r["v"] for r in out.where(F.col("rep") == rep).collect()}
        assert sorted(got.values()) == [float(i) for i in range(23)] and [got[i] for i in (20, 21, 22)] == [20.0, 21.0, 22.0]


def test_benjamini_hochberg_small_family(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.5)], "id long, p double")
    got = [r["fdr"] for r in agreement.benjamini_hochberg(df).orderBy("id").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


# ---- contracts, sources and sinks ----
def test_axis_contract(spark):
    lat = vectors(spark, np.eye(3))
    bad = spark.createDataFrame([(0, 5.0), (1, 20.0), (2, 50.0)], "cell_id long, t double")
    with pytest.raises(ValueError):
        assemble.latent_from_tables(bad, lat)
    lo, hi = assemble.latent_from_tables(bad, lat, rescale=True).agg(F.min("t"), F.max("t")).first()
    assert (lo, hi) == (0.0, 1.0)
    with pytest.raises(KeyError):
        assemble.latent_from_tables(bad.drop("t"), lat)
    wrong = spark.createDataFrame([(0, [1.0])], "cell_id long, v array<double>")
    assert assemble.latent_from_tables(bad, lat, wrong, rescale=True).where(F.col("v").isNotNull()).count() == 0


def test_bridge_population_counts_and_missing_labels(spark):
    from axisflow.plans.bridge import bridge_populations
    data = [(i, "CTRL") for i in range(200)] + [(200 + i, "A") for i in range(80)] + [(280 + i, "B") for i in range(80)]
    cells = spark.createDataFrame(data, "cell_id long, target string")
    got = {(t, s): n for t, s, n in rows(bridge_populations(cells, "target", "CTRL", ["A", "B", "C"]).groupBy("target", "side").count(), "target", "side")}
    assert got == {("A", "source"): 200, ("A", "target"): 80, ("B", "source"): 200, ("B", "target"): 80}
    with pytest.raises(ValueError):
        bridge_populations(cells, "target", "nobody", ["A"])


def test_builtin_network_and_set_labels(spark, tmp_path):
    human = readers.builtin_network(spark, "human")
    assert human.count() == readers.builtin_network(spark).count()
    assert human.where(F.col("target") == "HLA-DRA").count() == 1 and human.where(F.col("source") == "Gata1").count() == 0
    f = tmp_path / "sets.gmt"
    f.write_text("one\td\ta\tb\ntwo\td\tb\n")
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "cell string")
    got = rows(readers.label_by_set(cells, readers.read_set_file(spark, str(f))).select("cell", "label"), "cell")
    assert got == [("a", "one"), ("b", "two"), ("c", "Other")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b1", "fwd", "r", ["x", "y"])], "branch string, direction string, regulator string, top array<string>")
    writers.write_branch_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert "regulator" in back.columns and back.first()["top"] == "x, y"


def test_residuals_are_uncorrelated_with_covariates(spark):
    rng = np.random.default_rng(11)
    z = rng.normal(size=(200, 2))
    y = 2 * z[:, 0] - z[:, 1] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(z, y)], "a double, b double, y double")
    out, removed = prep.residualise(df, ["y"], ["a", "b"])
    assert abs(out.agg(F.corr("y_resid", "a")).first()[0]) < 1e-9 and removed["y"] > 0.99
