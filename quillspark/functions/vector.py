"""Vector functions as Column builders; elements count as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _v(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_v(a), _v(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_v(a), F.lit(0.0), lambda s, x: s + x * x))


def normalize(a: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, _v(a)).otherwise(F.transform(_v(a), lambda x: x / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_v(a), _v(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_similarity(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + squared_l2(a, b))


def check_dimension(a: Column | str, dim: int) -> Column:
    """The vector; another size raises."""
    c = F.col(a) if isinstance(a, str) else a
    return F.when(F.size(c) == dim, c).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(c).cast("string"))).cast("array<float>"))
