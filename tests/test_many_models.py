"""Embeddings, Krylov modes, graph searches and fits that share their passes, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisflow.operators import clustering, graph, spectra
from axisflow.plans.null_factor import METRICS, shuffle_null, shuffled_coordination


def vectors(spark, x, col="x"):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], f"cell_id long, {col} array<double>")


def test_wide_embedding_equals_the_exact_one(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 12)) * np.linspace(6, 1, 12) @ rng.normal(size=(12, 4096)) * 0.1 + rng.normal(size=(120, 4096)) * 0.02 + 1.0
    model = spectra.fit_embedding(vectors(spark, x, "j").repartition(3), "j", 4096, 5)
    sv = np.linalg.svd(x - x.mean(0), full_matrices=False)
    share = sv[1] ** 2 / (sv[1] ** 2).sum()
    assert np.abs(model["ratio"] - share[:5]).max() < 1e-6
    assert np.abs(np.abs((model["components"] * sv[2][:5]).sum(1)) - 1).max() < 1e-6
    small = spectra.fit_embedding(vectors(spark, x[:, :20], "j"), "j", 20, 3)
    wide = spectra.fit_embedding(vectors(spark, x[:, :20], "j"), "j", 20, 3, exact_width=4)
    assert np.allclose(small["ratio"], wide["ratio"], atol=1e-8) and np.allclose(small["components"], wide["components"], atol=1e-4)


def edges_of(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a != 0)], "i long, j long, v double")


def test_leading_modes_with_a_complex_pair(spark):
    rng = np.random.default_rng(2)
    n = 60
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    d = np.diag(rng.uniform(-0.6, 0.6, n))
    d[:2, :2] = [[0.9, -1.0], [1.0, 0.9]]
    a = q @ d @ q.T
    modes, found = spectra.leading_modes(edges_of(spark, a), 2)
    assert [f["re"] for f in found] == pytest.approx([0.9, 0.9]) and [f["im"] for f in found] == pytest.approx([1.0, -1.0])
    assert all(f["residual"] <= 1e-8 for f in found)
    for m, f in enumerate(found):
        z = np.array([complex(r["re"], r["im"]) for r in modes.where(F.col("mode") == m).orderBy("i").collect()])
        assert np.linalg.norm(z) == pytest.approx(1.0) and np.linalg.norm(a @ z - complex(f["re"], f["im"]) * z) < 1e-7
        top = z[np.abs(z).argmax()]
        assert top.real > 0 and abs(top.imag) < 1e-9
    with pytest.raises(ValueError):
        spectra.dominant_mode(edges_of(spark, a))


def test_dominant_mode_of_small_and_odd_operators(spark):
    got = {r["i"]: r["x"] for r in spectra.dominant_mode(edges_of(spark, np.diag([1.0, -3.0, 2.0]))).collect()}
    assert {k: round(v, 9) + 0.0 for k, v in got.items()} == {0: 0.0, 1: 1.0, 2: 0.0}
    sym = np.random.default_rng(3).normal(size=(30, 30))
    sym = sym + sym.T
    vals, vecs = np.linalg.eigh(sym)
    want = vecs[:, np.abs(vals).argmax()]
    x = np.array([r["x"] for r in spectra.dominant_mode(edges_of(spark, sym)).orderBy("i").collect()])
    assert np.allclose(x, want * np.sign(want[np.abs(want).argmax()]), atol=1e-7)


def plain_distances(n, edges, root):
    d = [float("inf")] * n
    d[root] = 0.0
    for _ in range(n):
        for a, b, w in edges:
            d[b], d[a] = min(d[b], d[a] + w), min(d[a], d[b] + w)
    return d


def test_graph_search_touches_the_frontier_only(spark):
    rng = np.random.default_rng(4)
    edges = [(i, int(j), float(rng.uniform(0.1, 2.0))) for i in range(150) for j in rng.choice(150, 3, replace=False) if i != j] + [(200, 201, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, dist double")
    log = []
    got = {r["cell_id"]: r["d"] for r in graph.graph_pseudotime(df, 0, log=log).collect()}
    want = plain_distances(202, edges, 0)
    assert all(got[i] == pytest.approx(want[i]) for i in range(150)) and got[200] is None
    assert log[0] == 1 and log[-1] == 0


def test_a_long_chain(spark):
    n = 30
    df = spark.createDataFrame([(i, i + 1, 1.0 + i % 3) for i in range(n)], "src long, dst long, dist double")
    log = []
    got = {r["cell_id"]: r["d"] for r in graph.graph_pseudotime(df, 0, log=log).collect()}
    assert got[n] == sum(1.0 + i % 3 for i in range(n)) and max(log) <= 2


def test_walks_move_what_arrived_only(spark):
    rng = np.random.default_rng(5)
    n = 80
    t = np.sort(rng.random(n))
    edges = [(i, int(j), float(rng.uniform(0.1, 1.0))) for i in range(n) for j in rng.choice(n, 4, replace=False) if j != i]
    term = {n - 1: "a", n - 2: "b", n - 5: "a"}
    w = np.zeros((n, n))
    for i, j, v in edges:
        if t[j] > t[i] and i not in term:
            w[i, j] += v
    w = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
    p = np.zeros((n, 2))
    for i, b in term.items():
        p[i, "ab".index(b)] = 1
    whole = p.copy()
    for _ in range(n):
        p = w @ p
        whole += p
    log = []
    grouped = spark.createDataFrame(edges, "src long, dst long, w double").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = graph.absorb_probabilities(grouped, spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "cell_id long, t double"),
                                     spark.createDataFrame(list(term.items()), "cell_id long, branch string"), log=log)
    got = np.zeros((n, 2))
    for r in out.collect():
        got[r["cell_id"], "ab".index(r["branch"])] = r["prob"]
    assert np.allclose(got, whole) and log[-1] == 0 and log[-2] < max(log)


def test_alpha_search_equals_one_fit_after_the_other(spark):
    rng = np.random.default_rng(6)
    truth = rng.integers(0, 4, 300)
    e = rng.normal(size=(4, 5))[truth] * 2 + rng.normal(size=(300, 5))
    o = rng.normal(size=(4, 5))[truth] + rng.normal(size=(300, 5)) * 2
    t = spark.createDataFrame([(i, int(v)) for i, v in enumerate(truth)], "cell_id long, truth int")
    alphas = (0.0, 0.3, 1.0)
    labels = clustering.alpha_labels(vectors(spark, e), vectors(spark, o), 4, 5, 5, alphas)
    z = lambda x: (x - x.mean(0)) / x.std(0)
    for alpha in alphas:
        x = (1 - alpha) * z(e) + alpha * z(o)
        got = np.array([r["cluster"] for r in labels.where(F.col("alpha") == alpha).orderBy("cell_id").collect()])
        centres = np.stack([x[got == c].mean(0) for c in range(4)])
        again = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        assert (again == got).mean() > 0.99  # a settled k-means
    out = clustering.alpha_search(vectors(spark, e), vectors(spark, o), t, 4, 5, 5, alphas).orderBy("alpha").collect()
    assert [r["alpha"] for r in out] == list(alphas) and all(r["n_clusters"] == 4 for r in out)
    assert [r["best"] for r in out].count(True) == 1 and max(out, key=lambda r: r["ari"])["best"]
    one = clustering.ari_nmi(labels.where("alpha = 0.3").join(t, "cell_id"), "truth", "cluster").first()
    assert (out[1]["ari"], out[1]["nmi"]) == pytest.approx((one["ari"], one["nmi"]))


def plain_nmf(m, w, iters, tol=1e-4):
    k, last = w.shape[1], np.inf
    h = np.linalg.solve(w.T @ w + 1e-6 * np.eye(k), w.T @ m)
    for _ in range(iters):
        w = np.maximum(m @ h.T @ np.linalg.inv(h @ h.T + 1e-6 * np.eye(k)), 0)
        err = np.linalg.norm(m - w @ h)
        if np.isfinite(last) and abs(last - err) / (last + 1e-8) < tol:
            return h, err
        last, h = err, np.linalg.solve(w.T @ w + 1e-6 * np.eye(k), w.T @ m)
    return h, last


def test_factorisations_share_passes_and_equal_plain_ones(spark):
    m = np.abs(np.random.default_rng(7).normal(size=(25, 3))) @ np.random.default_rng(8).normal(size=(3, 10))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(m)], "t_idx int, m array<double>").repartition(3)
    inits = [spectra.nmf_start(F.col("t_idx"), 3, s) for s in range(4)]
    starts = np.array([[r[s] for s in range(4)] for r in rows.select("t_idx", *inits).orderBy("t_idx").drop("t_idx").collect()])
    hs, errors = spectra.semi_nmf_models(rows, inits, 3, 10, 200)
    for s in range(4):
        h, err = plain_nmf(m, starts[:, s], 200)
        assert np.allclose(h, hs[s], atol=1e-6) and err == pytest.approx(errors[s], abs=1e-5)


def test_shuffle_null_runs_all_replicates(spark):
    m = np.abs(np.random.default_rng(7).normal(size=(25, 3))) @ np.random.default_rng(8).normal(size=(3, 10))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(m)], "t_idx int, m array<double>")
    both = shuffled_coordination(rows, 3, 10, 12, iters=60)
    assert sorted(r["rep"] for r in both.collect()) == list(range(-1, 12))
    null = shuffle_null(rows, 3, 10, 12, iters=60).collect()
    assert {r["metric"] for r in null} == set(METRICS) and all(0 <= r["p"] <= 1 for r in null)
