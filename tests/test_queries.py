"""A query of every family against its SQL on the smallest tables; ``check.py`` compares all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, norm

SF = "/root/testdata/sf0.001"

NAMES = ["network_tsv", "set_file_labels", "highly_variable", "population_select", "knn_folded", "proximal_join", "cluster_adjacency", "time_gate", "window_mean", "interior_peak",
         "kernel_smooth_adaptive", "gaussian_filter", "fate_bins", "resample_to_grid", "spectrum_identities", "sign_align", "instability_table", "low_pass", "sinkhorn_plan",
         "enrichment", "co_instability_edges", "soft_threshold", "centrality_mean", "compare_regimes_by_cell_type", "ari_nmi", "peak_stats", "neff", "t_tail", "spearman_of_scores", "benjamini_hochberg"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert os.path.isdir(SF)
