"""Distances and scores of vectors as column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Metric

#: Below this product of magnitudes a cosine is 0: the machine epsilon of a 32-bit float.
EPSILON = 1.1920929e-7


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def magnitude_squared(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: x * x))


def magnitude(v: Column) -> Column:
    return F.sqrt(magnitude_squared(v))


def cosine_similarity(a: Column, b: Column) -> Column:
    size = magnitude(a) * magnitude(b)
    return F.when(size < EPSILON, F.lit(0.0)).otherwise(dot_product(a, b) / size)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = magnitude(v)
    return F.when(size == 0, v).otherwise(F.transform(v, lambda x: x / size))


def normalized_similarity(a: Column, b: Column) -> Column:
    """Cosine of vectors of unit length."""
    return dot_product(a, b)


def normalized_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot_product(a, b)


def distance(metric: Metric, a: Column, b: Column) -> Column:
    """Smaller is nearer; the dot product is negated."""
    return {Metric.L2: l2_squared, Metric.COSINE: cosine_distance, Metric.DOT: lambda x, y: -dot_product(x, y)}[metric](a, b)


def distance_to_score(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d)


def to_similarity(metric: Metric, d: Column) -> Column:
    return {Metric.L2: distance_to_score, Metric.COSINE: lambda x: F.lit(1.0) - x, Metric.DOT: lambda x: -x}[metric](d)


def to_distance(metric: Metric, s: Column) -> Column:
    """For L2 the similarity is returned as it is, so this is no inverse there."""
    return {Metric.L2: lambda x: x, Metric.COSINE: lambda x: F.lit(1.0) - x, Metric.DOT: lambda x: -x}[metric](s)


def depth_score(depth: Column) -> Column:
    return F.lit(1.0) / (F.lit(1) + depth)


def checked(v: Column, dim: int) -> Column:
    """The vector, or an error if its dimension is another."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v).cast("string"))))
