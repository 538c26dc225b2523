"""Helpers shared by the corpus operators: column hygiene, size-checked joins, connected components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

BROADCAST_ROWS = 2_000_000  # rows of a few machine words each; beyond it a shuffled join is used

EDGES_PER_TASK = 50_000

SPACES = "\\x20\\x09-\\x0D"  # the six ASCII white-space characters, for a character class


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; columns of the same name in ``df`` give way, whatever their letter case."""
    given = {k.lower() for k in columns}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in given]
    return df.select(*rest, *[v.alias(k) for k, v in columns.items()])


def run_hashes(words: Column, size: int, short: bool = False) -> Column:
    """Hashes of all runs of ``size`` elements of an array; with ``short``, of a shorter array as a whole, else none of it.

    The array is bound to a lambda variable, so it is made once a row wherever the optimizer moves the expression.
    """
    def runs(w):
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))) if short else F.when(F.lit(False), F.array(F.lit(0).cast("long")))
        each = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        return F.when(F.size(w) >= size, each).otherwise(F.coalesce(whole, F.array().cast("array<bigint>")))
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one is an error that says so."""
    have = {c.lower(): c for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df.select(*[F.col(f"`{have[n.lower()]}`").alias(n) for n in names])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows; as it is beyond that.

    The caller passes a materialised table of a few narrow columns, so the count is cheap and bounds the bytes.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_held: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator; taking it drops what others have kept.

    Workers are reused by later stages, so without this their memory would be the sum over operators.
    """
    others = [k for k in _held if k != owner]
    for other in others:
        del _held[other]
    if others:
        give_back()
    return _held.setdefault(owner, {})


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    import ctypes

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers in batches of ``rows``, unless the session asks for fewer; the setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more.

    Spark does so when the driver collects garbage, by itself every half hour; an operator of many steps
    would keep all their files until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, root): the least node reachable from each node of an undirected edge list.

    Alternating large and small stars: every round hangs neighbours below the least node of each
    neighbourhood. Stars shrink to depth one in a logarithmic number of rounds; a node's neighbours
    are never gathered, only joined with their minimum.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    tasks = max(1, -(-e.count() // EDGES_PER_TASK))  # rounds over a few edges need not fill a cluster's partitions
    e, before = e.coalesce(tasks), None
    for _ in range(max_rounds):
        # large star: neighbours greater than the node go to the least of its neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks)
        # small star: smaller neighbours and the node itself go to the least of them
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut_lineage(hung.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
