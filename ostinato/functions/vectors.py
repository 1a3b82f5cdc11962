"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def sparse_dot(terms_a: Column, weights_a: Column, terms_b: Column, weights_b: Column) -> Column:
    """Dot product of two sparse vectors given as parallel arrays of distinct term ids and weights."""
    b = F.map_from_arrays(terms_b, weights_b)
    products = F.zip_with(terms_a, weights_a, lambda t, w: w * F.coalesce(F.element_at(b, t), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
