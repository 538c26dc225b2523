"""A sink of one folder per batch: a batch that runs again overwrites its own folder, so replays change nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RECEIVED = "batch long, received long"


def batch_sink(at: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: the batch goes to its own folder, in place of what an earlier attempt left there."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (prepare(batch) if prepare else batch).write.mode("overwrite").parquet(f"{at}/rows/batch={batch_id}")
    return write


def run_available(stream: DataFrame, at: str, output_mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None,
                  schema: T.StructType | None = None) -> None:
    """Bring the table below ``at`` up to date with all files that are there, and stop. Checkpoint and counts lie beside it.

    A later call goes on where this one ended; one that was broken off runs its last batch again.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], schema or stream.schema).write.mode("ignore").parquet(f"{at}/rows/batch=-1")  # a table also before the first batch
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    was = spark.conf.get(kept)
    spark.conf.set(kept, "1000000")
    try:
        query = (stream.writeStream.outputMode(output_mode).foreachBatch(batch_sink(at, prepare)).option("checkpointLocation", f"{at}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(kept, was)
    counts = [(p.batchId, p.numInputRows) for p in query.recentProgress]
    if counts:
        first = min(b for b, _ in counts)
        spark.createDataFrame(counts, _RECEIVED).groupBy("batch").agg(F.max("received").alias("received")).write.mode("overwrite").parquet(f"{at}/received/run={first}")


def batch_table(spark: SparkSession, at: str, schema: T.StructType) -> DataFrame:
    """All rows of all batches, with ``batch``."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).option("basePath", f"{at}/rows").parquet(f"{at}/rows")


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The row that the last batch wrote for each key, for sinks of updates."""
    rest = [c for c in table.columns if c not in keys and c != "batch"]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def received(spark: SparkSession, at: str) -> Column:
    """Rows read by all batches as a scalar; null if a broken run left a batch without its count."""
    counts = spark.read.schema(_RECEIVED).parquet(f"{at}/received").groupBy("batch").agg(F.max("received").alias("received"))
    done = spark.read.schema("batch long").option("basePath", f"{at}/rows").parquet(f"{at}/rows")  # the folders name the batches
    names = done.select("batch").where("batch >= 0").distinct()
    missing = names.join(counts, "batch", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.agg(F.when(missing == 0, F.coalesce(F.sum("received"), F.lit(0))).alias("n")).scalar()
