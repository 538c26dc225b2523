"""Overlapping windows of the axis over a stream.

The axis is event time. Rows are added up in panes, tumbling windows one window step long, so a row touches one state
row however many windows overlap there; windows are put together from the pane table. A watermark bounds the state:
rows of panes that lie behind it are dropped, and counted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import nearest_rows
from . import sink

SUMS = "n long, s double, n_edge long, s_edge double"


@dataclass(frozen=True)
class Axis:
    """``n`` windows of ``per_window`` steps each, in whole microseconds from ``start``."""

    start: int
    step: int
    per_window: int
    n: int

    @classmethod
    def over(cls, first: int, last: int, n: int = 100, overlap: float = 0.8) -> "Axis":
        """Windows that cover [first, last]; the last may end up to a step of a hundredth beyond. One step must divide a window."""
        per_window = round(1.0 / (1.0 - overlap))
        if abs(per_window * (1.0 - overlap) - 1.0) > 1e-9:
            raise ValueError(f"windows with an overlap of {overlap} are not a whole number of steps")
        return cls(first, max(1, math.ceil((last - first) / (n - 1 + per_window))), per_window, n)

    @property
    def span(self) -> int:
        return self.step * (self.n - 1 + self.per_window)

    def position(self, us: Column) -> Column:
        """Where a time in microseconds lies on [0, 1]."""
        return (us - F.lit(self.start)).cast("double") / F.lit(float(self.span))


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files at ``path``; new files are read in the order they were written."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def pane_sums(stream: DataFrame, axis: Axis, time: str = "ts", value: str = "value", keys: list[str] = (), delay: str = "1 hour") -> DataFrame:
    """Running sums by (keys, pane) of a stream or table: n, s, and both for rows exactly on the pane's first microsecond.

    Windows are closed, so a row on a pane's edge also belongs to the window that ends there. Rows off the axis, and
    rows without a time or value, are left out; of a stream, also rows of panes behind the watermark.
    """
    keys = list(keys)
    rows = stream.withColumn("_ts", F.col(time).cast("timestamp"))
    us = F.unix_micros("_ts")
    rows = rows.where(us.between(axis.start, axis.start + axis.span) & F.col(value).isNotNull())
    if rows.isStreaming:
        rows = rows.withWatermark("_ts", delay)
    pane = F.window("_ts", f"{axis.step} microseconds", startTime=f"{axis.start % axis.step} microseconds")
    edge = (us - axis.start) % axis.step == 0
    v = F.col(value).cast("double")
    sums = rows.groupBy(*keys, pane.alias("_pane")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.count(F.when(edge, 1)).alias("n_edge"), F.sum(F.when(edge, v).otherwise(0.0)).alias("s_edge"))
    index = F.expr(f"(unix_micros(_pane.start) - {axis.start}) div {axis.step}").cast("int")
    return sums.select(*keys, index.alias("pane"), "n", "s", "n_edge", "s_edge")


def run_panes(stream: DataFrame, at: str, axis: Axis, time: str = "ts", value: str = "value", keys: list[str] = (), delay: str = "1 hour") -> None:
    """Bring the pane table below ``at`` up to date with the files that are there."""
    sink.run_available(pane_sums(stream, axis, time, value, keys, delay), at, "update")


def pane_table(spark: SparkSession, at: str, schema: T.StructType, keys: list[str] = ()) -> DataFrame:
    """The pane sums as the last batch that touched them left them."""
    return sink.latest(sink.batch_table(spark, at, schema), [*keys, "pane"])


def window_curve(panes: DataFrame, axis: Axis, keys: list[str] = (), min_rows: int = 5) -> DataFrame:
    """(keys, t_idx, t, n, mean) of every window; the mean is null where a window has fewer than ``min_rows`` rows."""
    keys, k = list(keys), axis.per_window
    parts = panes.withColumn("t_idx", F.explode(F.sequence(F.col("pane") - k, F.col("pane")))).where(F.col("t_idx").between(0, axis.n - 1))
    whole = F.col("t_idx") > F.col("pane") - k  # else only the edge of the pane belongs to the window
    sums = parts.groupBy(*keys, "t_idx").agg(F.sum(F.when(whole, F.col("n")).otherwise(F.col("n_edge"))).alias("n"), F.sum(F.when(whole, F.col("s")).otherwise(F.col("s_edge"))).alias("s"))
    idx = F.explode(F.sequence(F.lit(0), F.lit(axis.n - 1))).alias("t_idx")
    frame = panes.select(*keys).distinct().select(*keys, idx) if keys else panes.sparkSession.range(1).select(idx)
    out = frame.join(sums, [*keys, "t_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    width = axis.step * k / axis.span
    return out.select(*keys, "t_idx", (F.col("t_idx") * F.lit(axis.step / axis.span) + F.lit(width / 2.0)).alias("t"), "n",
                      F.when(F.col("n") >= min_rows, F.col("s") / F.col("n")).alias("mean"))


def fill_sparse(curve: DataFrame, rows: DataFrame, axis: Axis, keys: list[str] = (), min_rows: int = 5, time: str = "ts", tie: str = "cell_id") -> DataFrame:
    """Windows without a mean take that of the ``min_rows`` stored rows nearest to their centre, as ``window_mean`` does."""
    keys = list(keys)
    on_axis = rows.withColumn("t", axis.position(F.unix_micros(F.col(time).cast("timestamp")))).where(F.col("value").isNotNull())
    sparse = curve.where(F.col("mean").isNull()).select(*keys, "t_idx", F.col("t").alias("_c"))
    near = nearest_rows(on_axis, sparse, min_rows, keys, tie).groupBy(*keys, "t_idx").agg(F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_m"))
    return curve.join(near, [*keys, "t_idx"], "left").select(*keys, "t_idx", "t", F.coalesce("_n", "n").alias("n"), F.coalesce("mean", "_m").alias("mean"))


def late_rows(panes: DataFrame, at: str) -> DataFrame:
    """(received, counted, late): rows read, rows in panes, and their difference: dropped behind the watermark or off the axis."""
    got = sink.received(panes.sparkSession, at)
    counted = panes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
    return counted.select(got.alias("received"), "counted", (got - F.col("counted")).alias("late"))
