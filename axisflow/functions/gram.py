"""Sums of products over a whole table: each task adds up its Arrow batches, Spark adds the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(df: DataFrame, fn: Callable[[pd.DataFrame], np.ndarray], width: int) -> np.ndarray:
    """Sum ``fn(batch)`` (a vector of ``width`` numbers) over all batches.

    One row per entry and task is shuffled, ``width`` numbers reach the driver; no row data does.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(width)
        for pdf in batches:
            if len(pdf):
                acc += fn(pdf)
        yield pd.DataFrame({"pos": np.arange(width, dtype="int32"), "val": acc})
    rows = df.mapInPandas(run, "pos int, val double").groupBy("pos").agg(F.sum("val").alias("val")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r["pos"]] = r["val"]
    return out


def second_moments(df: DataFrame, vec: str, dim: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, sum of x, sum of x x^T) of an array column."""
    def part(pdf: pd.DataFrame) -> np.ndarray:
        x = np.stack(pdf[vec])
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
    s = summed(df.select(vec), part, 1 + dim + dim * dim)
    return s[0], s[1:1 + dim], s[1 + dim:].reshape(dim, dim)
