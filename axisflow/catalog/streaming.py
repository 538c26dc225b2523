"""Windows and regimes from streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import staging_path
from ..streaming import panes, regimes
from .base import R, Tables, query, rounded, with_

_N, _K = 100, 5  # windows, and steps in one of them


def _axis_sql(keys: str, min_rows: int) -> str:
    by = f"{keys}, " if keys else ""
    return f"""WITH ends AS (SELECT min(epoch_us(ts)) AS lo, greatest(1, ceil((max(epoch_us(ts)) - min(epoch_us(ts)))::DOUBLE / {_N - 1 + _K}))::BIGINT AS step FROM events),
    win AS (SELECT i::INT AS t_idx, lo + i * step AS a, lo + (i + {_K}) * step AS b FROM (SELECT unnest(range({_N})) AS i), ends)
    SELECT {by}t_idx, {R(f'(t_idx + {_K / 2}e0) / {_N - 1 + _K}e0')} AS t, count(*) AS n, {R('avg(value)')} AS mean
    FROM win JOIN events ON epoch_us(ts) >= a AND epoch_us(ts) <= b WHERE value IS NOT NULL GROUP BY {by}t_idx HAVING count(*) >= {min_rows}"""


def _stream(t: Tables, keys: list[str]):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = t.events.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    axis = panes.Axis.over(ends["lo"], ends["hi"], _N, 0.8)
    at, source = staging_path(t.spark, "panes"), panes.file_stream(t.spark, f"{t.dir}/[e]vents.parquet", t.events.schema)
    panes.run_panes(source, at, axis, keys=keys)
    table = panes.pane_table(t.spark, at, panes.pane_sums(source, axis, keys=keys).schema, keys)
    return axis, at, table


@query("stream_window_mean", _axis_sql("", 1))
def _(t: Tables):
    axis, _, table = _stream(t, [])
    return rounded(panes.window_curve(table, axis, min_rows=1).where("n > 0"))


@query("stream_window_mean_by_key", _axis_sql("event_type", 1))
def _(t: Tables):
    axis, _, table = _stream(t, ["event_type"])
    return rounded(panes.window_curve(table, axis, ["event_type"], min_rows=1).where("n > 0"))


@query("stream_late_rows", "SELECT count(*) AS received, count(*) AS counted, 0::BIGINT AS late FROM events")
def _(t: Tables):
    _, at, table = _stream(t, [])
    return panes.late_rows(table, at)


def _classified(t: Tables):
    at = staging_path(t.spark, "regimes")
    source = panes.file_stream(t.spark, f"{t.dir}/[c]ustomer.parquet", t.customer.schema)
    metrics = t.metrics_of(source)
    regimes.run_regimes(metrics, at)
    return regimes.regime_table(t.spark, at, metrics.schema)


@query("stream_regimes", with_("reg", body=f"SELECT cell_id, cell_type, condition, {R('lambda_max')} AS lambda_max, {R('lambda_min')} AS lambda_min, {R('plasticity')} AS plasticity, {R('stable_dim')} AS stable_dim, regime FROM reg"))
def _(t: Tables):
    return rounded(_classified(t))


@query("stream_regime_counts", with_("reg", body=f"SELECT cell_type, regime, count(*) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY cell_type)')} AS share FROM reg GROUP BY cell_type, regime"))
def _(t: Tables):
    return rounded(regimes.regime_counts(_classified(t), ["cell_type"]))
