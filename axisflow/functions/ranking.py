"""Ranks, quantiles and row positions without collecting a key into one task.

Rows are first reduced to one per distinct value (partial aggregation), the value axis is cut into
segments whose number grows with the rows, and positions inside a segment are added to the segment's offset. A key
holding a third of all rows is spread over the segments like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENTS = 64            # at least
MOST_SEGMENTS = 4096     # at most, and at most four for each core of the cluster
PER_SEGMENT = 1_000_000  # rows a segment is meant to hold


def _splits(df: DataFrame, value: str, segments: int) -> Column:
    """Split points of the value axis as a scalar: ``segments``, doubled until a segment holds PER_SEGMENT rows."""
    doubled = [segments << i for i in range(20) if segments << i <= _most(df, segments)]
    most = doubled[-1]
    many = F.lit(most)
    for s in reversed(doubled[:-1]):
        many = F.when(F.col("n") <= s * PER_SEGMENT, s).otherwise(many)
    a = df.agg(F.percentile_approx(value, [i / most for i in range(1, most)], 10 * most).alias("s"), F.count(value).alias("n"))
    return a.withColumn("m", many).select(F.filter("s", lambda _, i: (i + 1) % (F.lit(most) / F.col("m")).cast("int") == 0)).scalar()


def with_segment(df: DataFrame, value: str, out: str, splits: Column, segments: int = SEGMENTS) -> DataFrame:
    """Add how many split points lie below the value (0 if there are none).

    The scalar becomes a column first, since a scalar subquery may not stand inside a lambda.
    """
    return df.withColumn("_splits", splits).withColumn(out, _below(value, F.col("_splits"), _most(df, segments))).drop("_splits")


def _most(df: DataFrame, segments: int) -> int:
    """Segments at most: four for each core, but not fewer than asked for."""
    return max(min(MOST_SEGMENTS, 4 * df.sparkSession.sparkContext.defaultParallelism), segments)


def _tree(value: str, splits: Column, lo: int, hi: int) -> Column:
    """The split points below the value among those from ``lo`` to ``hi``, as nested conditions that compile; missing ones are not below."""
    if lo == hi:
        return F.lit(lo)
    middle = (lo + hi) // 2
    return F.when(F.get(splits, F.lit(middle)) < F.col(value), _tree(value, splits, middle + 1, hi)).otherwise(_tree(value, splits, lo, middle))


def _below(value: str, splits: Column, most: int) -> Column:
    """Halves the range of split points: nested conditions for one range of segments, a loop over the array beyond it."""
    if most <= SEGMENTS:
        return _tree(value, splits, 0, SEGMENTS - 1)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(splits, middle) < F.col(value), F.lit(False))
        searching = s["lo"] < s["hi"]
        return F.struct(F.when(searching & below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(searching & ~below, middle).otherwise(s["hi"]).alias("hi"))
    start = F.struct(F.lit(0).alias("lo"), F.greatest(F.coalesce(F.size(splits), F.lit(0)), F.lit(0)).alias("hi"))
    rounds = F.array(*[F.lit(i) for i in range(MOST_SEGMENTS.bit_length())])
    return F.aggregate(rounds, start, halve)["lo"]


def prefix_counts(df: DataFrame, keys: list[str], value: str, tie: str | None = None,
                  segments: int = SEGMENTS, weight: str | None = None) -> DataFrame:
    """One row per (keys, value[, tie]) with ``n``, ``before`` (mass ordered ahead) and ``total``.

    ``weight`` replaces row counts by a sum of weights.
    """
    mass = F.count(F.lit(1)) if weight is None else F.sum(weight)
    src = df.where(F.col(value).isNotNull())
    order = [value] + ([tie] if tie else [])
    freq = src.groupBy(*keys, *order).agg(mass.alias("n"))
    freq = with_segment(freq, value, "_seg", _splits(src, value, segments), segments)
    # one row per key and segment: at most ``segments`` rows per key
    seg = freq.groupBy(*keys, "_seg").agg(F.sum("n").alias("_sn"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    run = part.orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0) if weight is None else F.lit(0.0)
    seg = seg.select(*keys, "_seg", F.coalesce(F.sum("_sn").over(run), zero).alias("_off"),
                     F.sum("_sn").over(part).alias("total"))
    inside = W.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = freq.withColumn("_in", F.coalesce(F.sum("n").over(inside), zero))
    out = out.join(seg, [*keys, "_seg"])
    return out.select(*keys, *order, "n", (F.col("_off") + F.col("_in")).alias("before"), "total")


def quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: list[str] = (),
              segments: int = SEGMENTS) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per key, one column per entry of ``probs``."""
    keys = list(keys)
    ranks = prefix_counts(df, keys, value, segments=segments)
    aggs = []
    for name, q in probs.items():
        h = F.lit(float(q)) * (F.col("total") - 1)
        for side, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"_{name}_f"))
    got = ranks.groupBy(*keys).agg(*aggs)
    cols = [(F.col(f"_{n}_lo") + F.col(f"_{n}_f") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n)
            for n in probs]
    return got.select(*keys, *cols)


def quantile_scalar(df: DataFrame, value: str, q: float) -> Column:
    """A quantile of the whole table as a scalar subquery."""
    return quantiles(df, value, {"q": q}).scalar()


def average_ranks(df: DataFrame, columns: dict[str, str], keys: list[str] = ()) -> DataFrame:
    """Add 1-based average ranks (ties share their mean rank) within ``keys``: {value column: rank column}.

    Each rank table is built from ``df`` itself and joined back, one row per distinct value.
    """
    keys, out = list(keys), df
    for value, rank in columns.items():
        r = prefix_counts(df, keys, value)
        out = out.join(r.select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(rank)), [*keys, value])
    return out


def row_positions(df: DataFrame, value: str, tie: str, keys: list[str] = (), out: str = "pos",
                  segments: int = SEGMENTS) -> DataFrame:
    """Add the 0-based position of each row in the order (value, tie) within ``keys``.

    Rows that share a value are cut by the tie column too, so a value repeated in a third of the
    rows does not end in one task. ``tie`` must be unique and numeric.
    """
    keys = list(keys)
    cut = with_segment(df, tie, "_sub", _splits(df, tie, segments), segments)
    pre = prefix_counts(cut, keys, value, tie="_sub", segments=segments)
    inside = W.partitionBy(*keys, value, "_sub").orderBy(tie)
    return (cut.withColumn("_rn", F.row_number().over(inside) - 1)
            .join(pre.drop("n", "total"), [*keys, value, "_sub"])
            .withColumn(out, (F.col("before") + F.col("_rn")).cast("long"))
            .drop("_sub", "_rn", "before"))


def top_n(df: DataFrame, n: int, order: list[Column], keys: list[str] = (), rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key with their rank. Spark limits each map task to ``n`` rows per key
    before the shuffle, so large keys stay small."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return df.withColumn(rank, F.row_number().over(part.orderBy(*order))).where(F.col(rank) <= n)
