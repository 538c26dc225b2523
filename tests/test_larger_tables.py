"""What must not grow with the rows: steps that larger tables have broken, on small inputs."""

import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_t_tail_of_many_degrees_of_freedom(spark):
    from axisflow.functions.special import t_two_sided
    df = spark.createDataFrame([(2.0, 1e7), (2.0, 1e9), (1.0, 1.0), (-1.0, 2.0), (0.0, 3.0), (None, 3.0)], "t double, df double")
    got = [r[0] for r in df.select(t_two_sided(F.col("t"), F.col("df"))).collect()]
    normal = math.erfc(math.sqrt(2.0))
    assert got[:5] == pytest.approx([normal, normal, 0.5, 1 - 1 / math.sqrt(3), 1.0], abs=1e-7) and got[5] is None


def test_matrix_is_written_and_numbered_in_pieces(spark, tmp_path, monkeypatch):
    from axisflow.catalog import base, sources
    from axisflow.sources import readers
    monkeypatch.setattr(sources, "staging_path", lambda _, name: str(tmp_path / name))
    got = base.QUERIES["matrix_triplets"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().count()
    pieces = sorted(glob.glob(os.path.join(tmp_path, "mtx", "matrix.mtx", "part-*")))
    assert len(pieces) > 1 and open(pieces[0]).readline().startswith("%%")
    plan = readers.numbered_lines(spark, str(tmp_path / "mtx" / "matrix.mtx"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan


def test_bridge_operators_equal_the_fit_over_all_pairs(spark):
    from axisflow.operators.field import local_linear_operator
    from axisflow.operators.spectra import operator_spectrum
    from axisflow.operators.transport import bridge_targets, moment_pairs
    from axisflow.operators.windows import linspace
    from axisflow.plans.bridge import bridge_operators
    rng = np.random.default_rng(4)
    x = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=2)]) for i in range(40)], "cell_id long, x array<double>")
    y = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=2) * [3, 1] + 2]) for i in range(60)], "cell_id long, x array<double>")
    links = sorted({(int(a), int(b), k) for a, b, k in zip(rng.integers(0, 40, 400), rng.integers(0, 60, 400), ["a", "b", "b", "c"] * 100)}, key=str)
    pairs = spark.createDataFrame(links, "i long, j long, k string").repartition(3)
    grid = linspace(0.03, 0.97, 6)
    for keys, some in (([], pairs.where("k = 'b'").drop("k")), (["k"], pairs)):
        by = [*keys, "direction", "t_idx"]
        whole = operator_spectrum(local_linear_operator(bridge_targets(some, x, y, grid), grid, 0.2, 2, 1e-3, keys=[*keys, "direction"]), 2)
        few = bridge_operators(some, x, y, 2, 6, 0.2, 1e-3, keys)
        one, two = ({tuple(r[c] for c in by): [r["n_rows"], *r["j"], r["lam"]] for r in d.collect()} for d in (whole, few))
        assert one.keys() == two.keys() and len(one) == 12 * max(1, 3 * len(keys))
        assert all(np.allclose(one[k], two[k], atol=1e-9) for k in one)
        assert moment_pairs(some, x, y, 2, keys)[0].count() == 8 * max(1, 3 * len(keys))


def test_wide_operators_go_out_in_pieces(spark, monkeypatch):
    from axisflow.catalog import base, spectra
    seen = []
    monkeypatch.setattr(spectra.s, "operator_embedding", lambda df, *a: seen.append(df) or (df.select("cell_id", F.col("j").alias("z")), {"ratio": np.ones(1)}))
    base.QUERIES["operator_embedding_wide"](spark, SF)
    assert "], 204" in seen[0]._jdf.queryExecution().optimizedPlan().toString()  # an iterator of batches
    rows = seen[0].join(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("cell_id") == F.col("vec_id"))
    off = rows.select(F.max(F.abs(F.col("j")[65] - F.col("embedding")[1].cast("double") * F.col("embedding")[1].cast("double"))), F.count("*")).first()
    assert off[0] < 1e-12 and off[1] == 500


def test_transport_rounds_compute_a_half_step_once(spark, monkeypatch):
    from axisflow.operators import transport
    seen = []
    cut = transport.cut_lineage
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    monkeypatch.setattr(transport, "cut_lineage", lambda df: seen.append((df.columns[:2], joins(df))) or cut(df))
    cost = spark.createDataFrame([(i, 100 + j, float((i * 7 + j * 3) % 5)) for i in range(6) for j in range(4)], "i long, j long, c double")
    done = transport.sinkhorn(cost, 2.0, partitions=2)
    masses = [r.m for r in done["plan"].groupBy("i").agg(F.sum("p").alias("m")).collect()]
    assert done["error"] <= transport.TOLERANCE and len(masses) == 6 and max(abs(m - 1 / 6) for m in masses) < 1e-6
    steps = [n for names, n in seen if names == ["j", "s"]]
    assert steps and max(steps) == 1
    assert max(n for names, n in seen if names == ["i", "s"]) <= 4 * transport.ROUNDS_PER_CUT


def test_binned_pullback_has_every_supplier_part_and_bin(spark):
    from axisflow.catalog import load
    got = load()[0]["binned_pullback"](spark, SF)
    rows, parts = got.count(), spark.read.parquet(f"{SF}/part.parquet").count()
    tfs, bins = got.select("tf").distinct().count(), got.select("bin").distinct().count()
    assert tfs == spark.read.parquet(f"{SF}/supplier.parquet").count() and rows == tfs * parts * bins and bins > 1


def test_graph_smooth_takes_every_component(spark):
    from axisflow.catalog import load
    got = load()[0]["graph_smooth"](spark, SF).groupBy("feature").count().collect()
    assert {r["feature"] for r in got} == set(range(1, 9)) and {r["count"] for r in got} == {spark.read.parquet(f"{SF}/embeddings.parquet").count()}


def test_labels_spread_until_they_settle(spark):
    from axisflow.operators.clustering import label_propagation
    line = [(i, i + 1, 2.0 ** (9 - i)) for i in range(9)]  # the heavier neighbour is the one with the smaller id
    graph = spark.createDataFrame(line + [(b, a, w) for a, b, w in line], "src long, dst long, w double")
    labels = lambda **k: sorted(map(tuple, label_propagation(graph, **k).collect()))
    log = []
    settled = labels(log=log)
    assert len(log) > 5 and log[-1] in log[:-1] and settled == labels(rounds=len(log)) != labels(rounds=4)
    pair = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, w double")  # takes turns for ever
    assert {r.cell_id for r in label_propagation(pair).collect()} == {1, 2}


def test_products_of_one_sign_are_summed_at_once(spark, monkeypatch):
    from axisflow.operators import grn
    monkeypatch.setattr(grn, "LEAF", 32)
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.normal(size=3) + 0.01 * rng.normal(size=(256, 3)) for _ in range(8)])
    b = np.concatenate([rng.normal(size=3) + 0.01 * rng.normal(size=(256, 3)) for _ in range(8)] + [rng.normal(size=(100, 3)), np.zeros((3, 3))])
    want, leaves, made = np.abs(a @ b.T).sum(1), grn._leaves(a), []
    monkeypatch.setattr(grn.np, "abs", lambda x, out=None, f=np.abs: made.append(x.size) or f(x, out=out))
    got = grn._abs_sums(a, b, leaves, grn._balls(a, leaves))
    assert sorted(np.concatenate(leaves)) == list(range(2048)) and max(map(len, leaves)) <= grn.LEAF
    assert np.allclose(got, want, rtol=1e-12) and sum(made) < a.shape[0] * b.shape[0] / 2
    vectors = spark.createDataFrame([(i % 4, i, [float(v) for v in x]) for i, x in enumerate(b)], "bin int, tf long, u array<double>")
    decode = spark.createDataFrame([(i // 2, [float(v) for v in x]) for i, x in enumerate(a)], "gene long, d array<double>").repartition(3)  # two rows a gene
    monkeypatch.setattr(grn, "HELD", 90)
    out = {(r.bin, r.gene): r.total for r in grn._outer_total(decode, vectors, ["bin"], 3).collect()}
    assert len(out) == 4 * 1024
    for k in range(4):
        per = np.abs(a @ b[k::4].T).sum(1).reshape(-1, 2).sum(1)
        assert np.allclose([out[k, g] for g in range(1024)], per, rtol=1e-12)


def test_rows_of_a_product_are_sent_to_few_blocks(spark, monkeypatch):
    from axisflow.operators import grn
    rng = np.random.default_rng(3)
    table = lambda n, names: spark.createDataFrame([(*(i % 2 for _ in names[2:]), i, [float(v) for v in rng.normal(size=2)]) for i in range(n)], names[0])
    decode, vectors = table(900, ["gene long, d array<double>", ""]), table(3000, ["bin int, tf long, u array<double>", "", ""])
    genes, packed, pairs = grn._dealt(decode, vectors, ["bin"])
    assert genes.count() == 900 and packed.count() == pairs == 32  # a gene goes to one block, not to one of each 256 vectors
    monkeypatch.setattr(grn, "DOT_ROWS", 100)
    genes, packed, pairs = grn._dealt(decode, vectors, ["bin"])
    assert pairs == 9 * 30 and genes.count() == 900 * 30 and packed.count() <= pairs
    got = grn._outer_dot(decode, vectors, ["bin"], 2)
    want = vectors.crossJoin(decode).select("bin", "tf", "gene", (F.col("d")[0] * F.col("u")[0] + F.col("d")[1] * F.col("u")[1]).alias("w"))
    off = got.join(want, ["bin", "tf", "gene"]).agg(F.count("*"), F.max(F.abs(F.col("v") - F.col("w")))).first()
    assert got.count() == off[0] == 900 * 3000 and off[1] < 1e-12


def test_wide_text_is_written_in_pieces(spark, tmp_path, monkeypatch):
    from axisflow.catalog import load, sources
    monkeypatch.setattr(sources, "staging_path", lambda _, name: str(tmp_path / name))
    got = load()[0]["gene_major_matrix"](spark, SF)
    pairs = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().count()
    pieces = sorted(glob.glob(os.path.join(tmp_path, "wide", "part-*")))
    lines = [line.rstrip("\n").split("\t") for p in pieces for line in open(p)]
    cells = sorted(r[0] for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect())
    assert len([p for p in pieces if os.path.getsize(p)]) > 2 and lines[0] == ["GENE", *[f"c{c}" for c in cells]]
    assert {len(line) for line in lines} == {len(cells) + 1} and sum(v != "0.0" for line in lines[1:] for v in line[1:]) == pairs == got.count()
