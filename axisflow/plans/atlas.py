"""Rows to stability regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.regimes import DEEP, EPS, PLASTICITY, TAU, classify_regime, regime_confidence, scale_axis
from ..operators.spectra import operator_spectrum, spectral_metrics


def atlas_from_spectra(spectra: DataFrame, eps: float = 0.1, tau: float = TAU, near: float = EPS, plasticity: float = PLASTICITY, deep: float = DEEP) -> DataFrame:
    """(cell_id, t, re, ...) -> scaled axis, metrics, regime and confidence. Narrow after the axis range."""
    m = spectral_metrics(scale_axis(spectra), eps)
    return regime_confidence(classify_regime(m, tau, near, plasticity, deep), tau, plasticity, deep)


def build_atlas(operators: DataFrame, dim: int, eps: float = 0.1, **thresholds) -> DataFrame:
    """(cell_id, t, j, ...) -> regimes: spectra are one Arrow stage without a shuffle."""
    return atlas_from_spectra(operator_spectrum(operators, dim).drop("j", "im", "v"), eps, **thresholds)
