"""Stability regimes of a stream of metric rows, in a sink that replays leave as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.regimes import classify_regime
from . import sink


def run_regimes(metrics: DataFrame, at: str, **thresholds) -> None:
    """Classify the rows of all files that are there into the table below ``at``; each row is looked at once, no state is kept."""
    sink.run_available(classify_regime(metrics, **thresholds), at, "append")


def regime_table(spark: SparkSession, at: str, schema: T.StructType) -> DataFrame:
    """The classified rows; ``schema`` is that of the metrics."""
    return sink.batch_table(spark, at, T.StructType([*schema.fields, T.StructField("regime", T.StringType())])).drop("batch")


def regime_counts(table: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows and share of each regime per key of a classified table, streamed or stored."""
    keys = list(keys)
    n = table.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("n"))
    total = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    both = n.join(total, keys) if keys else n.withColumn("_all", total.scalar())
    return both.select(*keys, "regime", "n", (F.col("n") / F.col("_all")).alias("share"))
