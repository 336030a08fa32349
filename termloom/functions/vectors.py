"""Vector functions on array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str, floor: float = 1e-9) -> Column:
    """The vector at length one; a shorter one than floor is divided by floor."""
    n = F.greatest(norm(v), F.lit(floor))
    return F.zip_with(_col(v), F.array_repeat(n, F.size(_col(v))), lambda x, y: x.cast("double") / y)


def cosine(a: Column | str, b: Column | str, floor: float = 1e-9) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))
