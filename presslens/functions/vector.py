"""Vector arithmetic on array columns and on sparse ML vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays; 0 when either is missing or zero."""
    return cosine_from(dot(a, b), norm(a), norm(b))


def cosine_from(dot_product: Column, norm_a: Column, norm_b: Column) -> Column:
    length = norm_a * norm_b
    return F.coalesce(F.when(length > 0, dot_product / length), F.lit(0.0))


def unwrapped(df: DataFrame, *cols: str) -> DataFrame:
    """Sparse ML vectors as ``struct(type, size, indices, values)``, which the functions below take.

    Unwrapping must be a projection of its own: inside a higher-order function it costs
    milliseconds a row. The functions name the column twice, so the optimizer leaves it so.
    """
    return df.withColumns({c: F.unwrap_udt(c) for c in cols})


def _if_any(parts: Column, value: Column) -> Column:
    return F.when(F.size(parts["values"]) > 0, value).otherwise(F.lit(0.0))


def sparse_sum(parts: Column) -> Column:
    return _if_any(parts, _total(parts["values"]))


def sparse_norm(parts: Column) -> Column:
    return _if_any(parts, norm(parts["values"]))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product in one pass over both index sets (``map_zip_with`` hashes)."""
    left = F.map_from_arrays(a["indices"], a["values"])
    right = F.map_from_arrays(b["indices"], b["values"])
    products = F.map_values(F.map_zip_with(left, right, lambda _, x, y: x * y))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
