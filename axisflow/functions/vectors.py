"""Array<double> arithmetic as Spark column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vec_sum(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def dot(a, b) -> Column:
    return vec_sum(F.zip_with(_c(a), _c(b), lambda p, q: p * q))


def dot_fixed(a, b, dim: int) -> Column:
    """Dot product of known width as plain arithmetic, which stays inside generated code."""
    x, y = _c(a), _c(b)
    out = x.getItem(0) * y.getItem(0)
    for i in range(1, dim):
        out = out + x.getItem(i) * y.getItem(i)
    return out


def norm(a) -> Column:
    return F.sqrt(vec_sum(F.transform(_c(a), lambda p: p * p)))


def sq_dist(a, b) -> Column:
    return vec_sum(F.zip_with(_c(a), _c(b), lambda p, q: (p - q) * (p - q)))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p + q)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p - q)


def scale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(s)
    return F.transform(_c(a), lambda p: p * s)


def unit(a, eps: float = 1e-8) -> Column:
    return scale(a, F.lit(1.0) / (norm(a) + F.lit(eps)))


def cosine(a, b, eps: float = 1e-12) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def as_doubles(a) -> Column:
    return _c(a).cast("array<double>")


def sum_vectors(col, dim: int, weight: Column | None = None) -> Column:
    """Elementwise sum over a group: ``dim`` plain sums, combined map-side, no explode."""
    x = _c(col)
    terms = [x.getItem(i) if weight is None else x.getItem(i) * weight for i in range(dim)]
    return F.array(*[F.sum(t) for t in terms])


def mean_vectors(col, dim: int) -> Column:
    x = _c(col)
    return F.array(*[F.avg(x.getItem(i)) for i in range(dim)])


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
