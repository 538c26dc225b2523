"""Streams of files: windows against the batch operator, late rows, restarts and replays."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from axisflow.operators.regimes import classify_regime
from axisflow.operators.windows import window_mean
from axisflow.streaming import panes, regimes, sink

SCHEMA = "cell_id long, ts timestamp, value double, kind string"
START = dt.datetime(2024, 1, 1)


def events(n, shift=0.5):
    """Rows every seven seconds; without the shift many lie exactly on a pane's edge."""
    return [(i, START + dt.timedelta(seconds=i * 7 % 5200 + shift), float(i * 31 % 17), "ab"[i % 2]) for i in range(n)]


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def batch(spark, rows, axis, keys=()):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("t", axis.position(F.unix_micros("ts")))
    return sorted((*[r[k] for k in keys], r["t_idx"], r["n"], round(r["mean"], 9)) for r in window_mean(df, axis.n, 0.8, min_rows=5, keys=list(keys)).collect())


def table(spark, at, source, axis, keys=()):
    return panes.pane_table(spark, at, panes.pane_sums(source, axis, keys=list(keys)).schema, list(keys))


@pytest.mark.parametrize("keys", [(), ("kind",)])
def test_stream_equals_batch_over_restarts(spark, tmp_path, keys):
    folder, at = str(tmp_path / "in"), str(tmp_path / "out")
    axis = panes.Axis.over(1704067200_000_000, 1704067200_000_000 + 5200_000_000, 100, 0.8)
    assert axis.step == 50_000_000 and axis.span == 5200_000_000
    rows = events(600)
    os.makedirs(folder)
    source = panes.file_stream(spark, f"{folder}/*", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    for i in range(3):  # each call starts from the checkpoint of the one before
        write(spark, rows[200 * i:200 * i + 200], folder, f"p{i}")
        panes.run_panes(source, at, axis, keys=list(keys), delay="3 hours")
    stored = spark.createDataFrame(rows, SCHEMA)
    curve = panes.fill_sparse(panes.window_curve(table(spark, at, source, axis, keys), axis, list(keys)), stored, axis, list(keys))
    got = sorted((*[r[k] for k in keys], r["t_idx"], r["n"], round(r["mean"], 9)) for r in curve.collect())
    assert got == batch(spark, rows, axis, keys)
    panes.run_panes(source, at, axis, keys=list(keys), delay="3 hours")  # nothing new
    seen = panes.late_rows(table(spark, at, source, axis, keys), at).first()
    assert tuple(seen) == (600, 600, 0)


def test_windows_are_closed_at_both_ends(spark):
    axis = panes.Axis.over(1704067200_000_000, 1704067200_000_000 + 5200_000_000, 100, 0.8)
    rows = events(600, shift=0)
    sums = panes.pane_sums(spark.createDataFrame(rows, SCHEMA), axis)
    got = {r["t_idx"]: (r["n"], r["mean"]) for r in panes.window_curve(sums, axis).collect()}
    for i in range(100):
        inside = [v for _, ts, v, _ in rows if i * 50 <= (ts - START).total_seconds() <= i * 50 + 250]
        assert got[i] == (len(inside), pytest.approx(sum(inside) / len(inside)) if len(inside) >= 5 else None)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    folder, at = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)
    axis = panes.Axis.over(1704067200_000_000, 1704067200_000_000 + 5200_000_000, 100, 0.8)
    source = panes.file_stream(spark, f"{folder}/*", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    early = [(i, START + dt.timedelta(seconds=10 * i), 1.0, "a") for i in range(400)]          # up to 3990 s
    late = [(1000 + i, START + dt.timedelta(seconds=100 + i), 99.0, "a") for i in range(20)]   # panes long closed
    fine = [(2000 + i, START + dt.timedelta(seconds=4000 + i), 1.0, "a") for i in range(20)]
    off = [(3000, START - dt.timedelta(seconds=5), 1.0, "a"), (3001, None, 1.0, "a"), (3002, START, None, "a")]
    for i, some in enumerate([early, late + fine + off]):
        write(spark, some, folder, f"p{i}")
        panes.run_panes(source, at, axis, delay="10 minutes")
    kept = table(spark, at, source, axis)
    assert tuple(panes.late_rows(kept, at).first()) == (443, 420, 23)
    assert {r["mean"] for r in panes.window_curve(kept, axis).where("n > 0 and mean is not null").collect()} == {1.0}


def test_empty_stream_has_an_empty_table(spark, tmp_path):
    folder, at = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)
    axis = panes.Axis.over(0, 1000, 10, 0.8)
    write(spark, [], folder, "none")
    source = panes.file_stream(spark, f"{folder}/*", spark.createDataFrame([], SCHEMA).schema)
    panes.run_panes(source, at, axis)
    curve = panes.window_curve(table(spark, at, source, axis), axis).collect()
    assert len(curve) == 10 and all(r["n"] == 0 and r["mean"] is None for r in curve)


def test_axis_needs_whole_steps():
    with pytest.raises(ValueError):
        panes.Axis.over(0, 1000, 10, 0.7)


METRICS = "cell_id long, lambda_max double, lambda_min double, plasticity double"


def test_replayed_batches_change_nothing(spark, tmp_path):
    folder, at = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)
    rows = [(i, i / 50 - 0.4, -i / 20, (i % 10) / 10) for i in range(60)] + [(60, None, None, None), (7, 0.2, 0.0, 0.0)]
    whole = spark.createDataFrame(rows, METRICS)
    source = panes.file_stream(spark, f"{folder}/*", whole.schema, files_per_batch=1)
    for i in range(2):
        spark.createDataFrame(rows[31 * i:31 * i + 31], METRICS).coalesce(1).write.parquet(f"{folder}/p{i}")
        regimes.run_regimes(source, at)
    read = lambda: sorted((tuple(r) for r in regimes.regime_table(spark, at, whole.schema).collect()), key=repr)
    want = sorted((tuple(r) for r in classify_regime(whole).collect()), key=repr)
    assert read() == want
    # the sink is called again for a batch, as after a crash between its write and the commit
    again = classify_regime(spark.createDataFrame(rows[31:], METRICS))
    sink.batch_sink(at)(again, 1)
    assert read() == want
    shares = regimes.regime_counts(regimes.regime_table(spark, at, whole.schema)).collect()
    assert sum(r["n"] for r in shares) == 62 and sum(r["share"] for r in shares) == pytest.approx(1.0)
