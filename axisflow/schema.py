"""Guards on input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Return ``df`` or raise ``KeyError`` naming the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing column(s) {missing}; table has {df.columns}")
    return df


def require_unit_interval(df: DataFrame, column: str = "t", tol: float = 1e-6) -> DataFrame:
    """Raise ``ValueError`` if the axis leaves [0, 1]. Runs one aggregate."""
    lo, hi = require(df, column).agg(F.min(column), F.max(column)).first()
    if lo is not None and (lo < -tol or hi > 1 + tol):
        raise ValueError(f"axis '{column}' spans [{lo}, {hi}], expected [0, 1]; rescale it first")
    return df


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """Turn NaN into NULL so that aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
