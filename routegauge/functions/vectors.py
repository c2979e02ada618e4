"""Dense vector arithmetic on array columns. All sums run in double precision."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def as_double(vec) -> Column:
    return (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    """Squared Euclidean norm."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(norm2(a))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def scaled(a: Column, divisor: Column) -> Column:
    return F.transform(a, lambda x: x / divisor)


def unit_vector(a: Column) -> Column:
    return scaled(a, norm(a) + F.lit(EPS))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mean_vector(vec: Column) -> Column:
    """Aggregate: element-wise mean. Partial sums are combined map-side, so a hot group costs one row per task."""
    return vector_to_array(Summarizer.mean(array_to_vector(vec)))


def sum_vector(vec: Column) -> Column:
    """Aggregate: element-wise sum, combined map-side."""
    return vector_to_array(Summarizer.sum(array_to_vector(vec)))
