"""Sinks: run results as partitioned Parquet, branch tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import require


def write_results(run: str, tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per result, partitioned by run; other runs in the folder are kept."""
    for name, df in tables.items():
        (df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{folder}/{name}"))


def read_results(spark: SparkSession, folder: str, name: str, run: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}")
    return df.where(F.col("run") == run) if run else df


def write_branch_csv(df: DataFrame, folder: str) -> None:
    """One CSV folder per branch and direction; array columns are joined with ', '."""
    require(df, "branch", "direction")
    flat = df.withColumns({c: F.array_join(c, ", ") for c, t in df.dtypes if t.startswith("array")})
    flat.write.mode("append").partitionBy("branch", "direction").option("header", True).csv(folder)
