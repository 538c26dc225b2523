"""Known answers where frames, walks, files or divisors leave the ordinary path."""

from itertools import permutations

import numpy as np
import pytest

from axisflow.operators import agreement, field, graph, grn, prep, windows
from axisflow.sources import readers


@pytest.mark.parametrize("size, block", [(25, 5), (101, 10), (7, 1000)])
def test_rolling_mean_with_frames_longer_than_a_block(spark, size, block):
    v = np.random.default_rng(size).normal(size=60)
    rows = spark.createDataFrame([(i, i / 60.0, float(x)) for i, x in enumerate(v)], "cell_id long, t double, value double")
    got = {r.cell_id: r.smooth for r in windows.rolling_mean(rows, size, block=block).collect()}
    before, after = size // 2, size - 1 - size // 2
    for i in range(60):
        assert got[i] == pytest.approx(v[max(0, i - before):i + after + 1].mean())


def test_chain_longer_than_any_round_count(spark):
    n = 30
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)] + [(100, 101, 1.0)], "src long, dst long, dist double")
    got = {r.cell_id: (r.d, r.t) for r in graph.graph_pseudotime(edges, 0).collect()}
    assert all(got[i][0] == i for i in range(n + 1)) and got[100][0] is None and got[100][1] == pytest.approx(0.5)


def test_walks_of_any_length_are_absorbed(spark):
    n = 20
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)] + [(0, 50, 3.0), (60, 61, 0.0)], "src long, dst long, w double")
    axis = spark.createDataFrame([(i, float(i)) for i in [*range(n + 1), 50, 60, 61]], "cell_id long, t double")
    ends = spark.createDataFrame([(n, "a"), (50, "b")], "cell_id long, branch string")
    got = {(r.cell_id, r.branch): r.prob for r in graph.absorb_probabilities(edges, axis, ends).collect()}
    assert got[0, "a"] == pytest.approx(0.25) and got[0, "b"] == pytest.approx(0.75) and got[1, "a"] == 1.0


def test_best_match_of_eight(spark):
    rng = np.random.default_rng(4)
    big, small = rng.uniform(size=(8, 8)), rng.uniform(size=(5, 5))
    cells = [("p", i, j, float(small[i, j])) for i in range(5) for j in range(5)]
    frame = spark.createDataFrame(cells, "g string, ka int, kb int, c double")
    best = max(sum(small[i, p[i]] for i in range(5)) for p in permutations(range(5))) / 5
    assert agreement.best_match(frame, 5, ["g"]).first().mean_matched == pytest.approx(best)
    frame = spark.createDataFrame([(i, j, float(big[i, j])) for i in range(8) for j in range(8)], "ka int, kb int, c double")
    best = max(sum(big[i, p[i]] for i in range(8)) for p in permutations(range(8))) / 8
    assert agreement.best_match(frame, 8).first().mean_matched == pytest.approx(best)


def test_feature_named_like_the_header(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("GENE\tc1\tc2\nGENE\t2\t0\ng\t0\t3\n")
    got = readers.gene_major_to_long(spark, str(tmp_path / "m.tsv"))
    assert sorted(map(tuple, got.collect())) == [("c1", "GENE", 2.0), ("c2", "g", 3.0)]


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("s1\td\tx\n" * 3)
    (tmp_path / "b.txt").write_text("s2\td\tx\ty\n")
    lines = readers.numbered_lines(spark, str(tmp_path))
    assert sorted(r.line for r in lines.collect()) == [0, 1, 2, 3]
    cells = spark.createDataFrame([("x",), ("z",)], "cell string")
    got = readers.label_by_set(cells, readers.read_set_file(spark, str(tmp_path)))
    assert sorted(map(tuple, got.select("cell", "label").collect())) == [("x", "s2"), ("z", "Other")]


def test_first_row_of_a_gene_name(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("e1\tA\tGene Expression\tchr1\t500\t600\ne2\tA\tGene Expression\tchr1\t100\t200\np1\tp\tPeaks\tchr1\t9\t10\np1\tp\tPeaks\tchr1\t1\t2\np2\tp\tPeaks\tchr1\t3\tNA\n")
    got = readers.read_feature_table(spark, str(tmp_path / "f.tsv"))
    assert sorted((r.feature_id, r.start, r.end) for r in got.collect()) == [("e1", 500, 600), ("p1", 9, 10), ("p2", 3, None)]


def test_zero_divisors(spark):
    flat = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.5, -1.0)], "cell_id long, t double, value double")
    assert windows.weighted_centre(flat).first().centre is None
    assert windows.bin_mean_std(flat, 4).collect() == []
    points = spark.createDataFrame([(1.0, float(i), 1.0, 0.0) for i in range(6)], "px double, py double, vx double, vy double")
    assert {r.ix for r in field.grid_flow(points, bins=2, min_rows=1).collect()} == {0}
    zero = spark.createDataFrame([(1, 7, 0.0), (2, 7, 3.0)], "cell_id long, feature long, value double")
    assert {r.cell_id: r.value for r in prep.normalize_total(zero, 1.0, log1p=False).collect()} == {1: 0.0, 2: 1.0}
    edges = spark.createDataFrame([(1, 2, 0.0), (2, 1, 1.0)], "src long, dst long, w double")
    values = spark.createDataFrame([(1, "f", 5.0), (2, "f", 6.0)], "cell_id long, feature string, value double")
    assert {r.cell_id: r.value for r in graph.graph_smooth(edges, values, 1).collect()} == {1: 0.0, 2: 5.0}


def test_gaps_between_bins_are_zeros(spark):
    k = spark.createDataFrame([(0, "t", "g", 1.0), (2, "t", "g", 1.0)], "bin int, tf string, gene string, v double")
    assert grn.grn_objective(k, k).first().temporal == pytest.approx(1.0)
    moved = {r.bin: r.v for r in grn.refine_grn(k, 1, lr=0.1, lam_temporal=0.5).collect()}
    assert moved == {0: pytest.approx(0.9), 1: pytest.approx(0.2), 2: pytest.approx(0.9)}
    assert [r.v for r in grn.refine_grn(spark.createDataFrame([(0, "t", "g", -1.0), (0, "t", "h", 1.0)], k.schema), 1, positive=True).collect()] == [1.0]


def test_every_cell_has_a_set_score(spark):
    expr = spark.createDataFrame([(1, "a", 2.0), (2, "z", 5.0), (3, "b", 1.0)], "cell_id long, feature string, value double")
    sets = spark.createDataFrame([("s", "a")], "set_name string, feature string")
    got = {r.cell_id: r.score for r in prep.gene_set_score(expr, sets, n_bins=1, ctrl_size=1).collect()}
    assert set(got) == {1, 2, 3} and got[1] == pytest.approx(2.0)


def test_a_lone_feature_of_a_bin_scores_one(spark):
    rows = [(c, f, float(np.log1p(v))) for f, vs in {"low1": (1, 0, 1), "low2": (2, 0, 0), "high": (900, 5, 100)}.items() for c, v in enumerate(vs)]
    expr = spark.createDataFrame(rows, "cell_id int, feature string, value double")
    got = {r.feature: r.score for r in prep.highly_variable(expr, 3, 3, n_bins=2).collect()}
    assert got["high"] == 1.0
    counts = {f: np.array(v, float) for f, v in {"low1": (1, 0, 1), "low2": (2, 0, 0)}.items()}
    d = {f: np.log((v.var(ddof=1) + 1e-12) / v.mean()) for f, v in counts.items()}
    assert got["low2"] == pytest.approx((d["low2"] - np.mean(list(d.values()))) / np.std(list(d.values()), ddof=1))
