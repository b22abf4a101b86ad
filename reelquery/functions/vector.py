"""Vector expressions on array columns. Sums run in double precision in array order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; the cosine of unit vectors. Null if a vector is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column | str, zero: str = "keep", epsilon: float = 1e-12) -> Column:
    """Unit length in double precision. A zero vector stays ("keep"), becomes null ("null"), or its norm is
    taken as at least ``epsilon`` ("floor"); "add" adds ``epsilon`` to every norm."""
    v = F.col(v) if isinstance(v, str) else v
    n = norm(v)
    by = {"keep": F.when(n == 0, 1.0).otherwise(n), "null": F.when(n > 0, n), "floor": F.greatest(n, F.lit(epsilon)), "add": n + epsilon}[zero]
    # as an array, the length is found once a vector; inside the function it would be found for every component
    return F.when(by.isNotNull(), F.zip_with(v, F.array_repeat(by, F.size(v)), lambda x, n: x.cast("double") / n))
