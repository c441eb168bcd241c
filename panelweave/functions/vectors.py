"""Colour and vector measures on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    na, nb = norm(a), norm(b)
    return F.when((na < TINY) | (nb < TINY), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def l2_normalize(v: Column) -> Column:
    size = norm(v)
    return F.when(size < TINY, F.transform(v, lambda x: x.cast("double"))).otherwise(
        F.transform(v, lambda x: x.cast("double") / size)
    )


def color_similarity(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    squares = sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0]))
    return F.least(F.greatest(F.lit(1.0) - F.sqrt(squares) / F.lit(255.0 * 3.0**0.5), F.lit(0.0)), F.lit(1.0))
