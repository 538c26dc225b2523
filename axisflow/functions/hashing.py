"""Randomness that depends on row keys only, so results do not change with partitioning or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 2**53


def uniform(*keys, seed: int = 0) -> Column:
    """A number in (0, 1) derived from the keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    h = F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(_SPAN))
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(_SPAN))


def normal(*keys, seed: int = 0) -> Column:
    """A standard normal number from two hashed uniforms."""
    u = uniform(*keys, seed=2 * seed + 101)
    v = uniform(*keys, seed=2 * seed + 102)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def poisson_one(*keys, seed: int = 0) -> Column:
    """A Poisson(1) count by inversion, exact to the double it is drawn from."""
    u = uniform(*keys, seed=seed)
    steps, cumulative, p = [], 0.0, math.exp(-1.0)
    for k in range(18):
        cumulative += p
        steps.append(F.lit(cumulative))
        p /= k + 1
    # the count is the number of cumulative steps below u
    return (F.array_position(F.sort_array(F.array_append(F.array(*steps), u)), u) - 1).cast("int")
