"""Real Fourier transform along the entries of each row vector, and what is read off the spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Band limits as fractions of the frequency index.
LOW_END, MID_END = 0.2, 0.6


def _by_length(x: pd.Series):
    """(length, positions) of the non-null, non-empty arrays of a series."""
    sizes = np.array([0 if v is None else len(v) for v in x])
    return [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes) if n]


def dft(rows: DataFrame, col: str = "x") -> DataFrame:
    """Add ``re`` and ``im`` (real transform of the array column). Rows are independent: no shuffle.

    Rows of one length are one matrix, multiplied by the cosines and sines of that length.
    """
    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def transform(x: pd.Series) -> pd.DataFrame:
        out: list = [(None, None)] * len(x)
        for n, at in _by_length(x):
            phase = 2 * np.pi / n * (np.outer(np.arange(n), np.arange(n // 2 + 1)) % n)
            m = np.stack([np.asarray(x.iloc[i], float) for i in at])
            for i, re, im in zip(at, m @ np.cos(phase), -(m @ np.sin(phase))):
                out[i] = (re, im)
        return pd.DataFrame(out, columns=["re", "im"])
    return rows.withColumn("_z", transform(col)).select(*rows.columns, "_z.re", "_z.im")


def idft(spectra: DataFrame, n: int, out: str = "x_back") -> DataFrame:
    """Inverse of :func:`dft` back to length ``n``, as one product per batch."""
    k = np.arange(n // 2 + 1)
    phase = 2 * np.pi / n * (np.outer(k, np.arange(n)) % n)
    twice = np.where((k == 0) | (2 * k == n), 1.0, 2.0)[:, None] / n
    cos, sin = twice * np.cos(phase), twice * np.sin(phase)

    @F.pandas_udf("array<double>")
    def back(re: pd.Series, im: pd.Series) -> pd.Series:
        result: list = [None] * len(re)
        for size, at in _by_length(re):
            use = min(size, len(k))
            a, b = (np.stack([np.asarray(c.iloc[i], float)[:use] for i in at]) for c in (re, im))
            for i, v in zip(at, a @ cos[:use] - b @ sin[:use]):
                result[i] = v
        return pd.Series(result)
    return spectra.withColumn(out, back("re", "im"))


def to_long(spectra: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, k, re, im, mag, phase), packed as one row per coefficient."""
    z = spectra.select(key, F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select(key, "k", "z.re", "z.im")
    return z.withColumns({"mag": F.hypot("re", "im"), "phase": F.atan2("im", "re")})


def band(k: str, n_coef: int, splits: tuple[float, float] = (LOW_END, MID_END)) -> Column:
    k1, k2 = int(n_coef * splits[0]), int(n_coef * splits[1])
    return F.when(F.col(k) < k1, "low").when(F.col(k) < k2, "mid").otherwise("high")


def split_bands(spectra: DataFrame, n_coef: int, splits: tuple[float, float] = (LOW_END, MID_END)) -> DataFrame:
    """Arrays re_low, im_low, ... with zeros outside the band."""
    k1, k2 = int(n_coef * splits[0]), int(n_coef * splits[1])
    limits = {"low": (0, k1), "mid": (k1, k2), "high": (k2, n_coef)}
    cols = {}
    def keep(a: int, b: int):
        return lambda v, i: F.when((i >= a) & (i < b), v).otherwise(F.lit(0.0))
    for name, (a, b) in limits.items():
        for part in ("re", "im"):
            cols[f"{part}_{name}"] = F.transform(part, keep(a, b))
    return spectra.withColumns(cols)


def merge_bands(bands: DataFrame) -> DataFrame:
    """Sum the three bands back to re and im."""
    def add3(p):
        two = F.zip_with(f"{p}_low", f"{p}_mid", lambda a, b: a + b)
        return F.zip_with(two, F.col(f"{p}_high"), lambda a, b: a + b)
    return bands.withColumns({"re": add3("re"), "im": add3("im")})


def band_power(long: DataFrame, n_coef: int, key: str = "cell_id") -> DataFrame:
    """Mean power per row and band."""
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return long.withColumn("band", band("k", n_coef)).groupBy(key, "band").agg(F.avg(p).alias("power"))


def low_pass(rows: DataFrame, n: int, cutoff: float = 0.6, col: str = "x") -> DataFrame:
    """Zero the coefficients from ``cutoff`` of the spectrum upwards and transform back (column smooth)."""
    kc = int((n // 2 + 1) * cutoff)
    z = dft(rows, col)
    keep = {p: F.transform(p, lambda v, i: F.when(i < kc, v).otherwise(F.lit(0.0))) for p in ("re", "im")}
    return idft(z.withColumns(keep), n, "smooth").drop("re", "im")


def roughness(long: DataFrame, key: str = "cell_id") -> DataFrame:
    """Mean squared step of the magnitude along k, over all rows (one spectrum per key is ordered)."""
    mag = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im") + F.lit(1e-8))
    w = W.partitionBy(key).orderBy("k")
    d = long.withColumn("_m", mag).withColumn("_d", F.lead("_m").over(w) - F.col("_m"))
    return d.agg(F.avg(F.col("_d") * F.col("_d")).alias("roughness"))


def band_weighted_difference(a: DataFrame, b: DataFrame, n_coef: int, weights: tuple[float, float, float] = (1.0, 1.0, 0.5),
                             key: str = "cell_id") -> DataFrame:
    """Mean squared difference of two long spectra with one weight per band."""
    other = b.select(key, "k", F.col("re").alias("re2"), F.col("im").alias("im2"))
    d = a.join(other, [key, "k"])
    w = F.when(F.col("k") < int(LOW_END * n_coef), weights[0]).when(F.col("k") < int(MID_END * n_coef), weights[1]).otherwise(weights[2])
    err = F.pow(F.col("re") - F.col("re2"), 2) + F.pow(F.col("im") - F.col("im2"), 2)
    return d.agg(F.avg(w * err).alias("difference"))
