"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "axisflow", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow transfer.

    Partition counts are left to the cluster's own settings unless passed in ``conf``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="axisflow-")
    sc.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives executor loss."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table that is written and read back."""
    return os.path.join(shared_dir(spark), f"stage-{uuid.uuid4().hex}", name)


def cut_to_table(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table below the shared folder and read it back.

    Unlike a checkpoint it also drops what the optimizer has inferred about the rows, which grows round by round in
    long loops of conditional columns.
    """
    spark = df.sparkSession
    at = staging_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
