"""Whole-table statistics as scalar subqueries (no cross join, no driver round trip)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stat(df: DataFrame, **aggs: Column) -> Column:
    """A struct column of aggregates over ``df``; read fields with ``stat(...)['name']``."""
    names = list(aggs)
    one = df.agg(*[aggs[n].alias(n) for n in names])
    return one.select(F.struct(*names)).scalar()
