"""Registered queries: each operator on the given tables, with its equivalent SQL where there is one."""

from __future__ import annotations

from importlib import import_module

from .base import ORACLES, QUERIES

_FAMILIES = ("sources", "prep", "neighbors", "field", "windows", "spectra", "transport", "regulators", "grn", "regimes", "nulls", "agreement", "streaming")


def load() -> tuple[dict, dict]:
    for name in _FAMILIES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
