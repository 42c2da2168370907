"""Expressions over array<float|double> vectors, and vector aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def scale(v: Column, by: Column | float) -> Column:
    factor = by if isinstance(by, Column) else F.lit(by)
    return F.transform(doubles(v), lambda x: x * factor)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `use`; inside a lambda it would be once per element."""
    return F.transform(F.array(value), use)[0]


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    def by_norm(a: Column) -> Column:
        return _bind(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))
    return _bind(doubles(v), by_norm)


def has_bad_value(v: Column) -> Column:
    """Null element, NaN or infinity."""
    return F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def nan_to_zero(v: Column) -> Column:
    return F.transform(doubles(v), lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x))


def weighted_concat(blocks: list[Column], weights: list[float]) -> Column:
    """Concatenate blocks, each scaled by its weight; the weights must be numbers that sum to 1."""
    if len(blocks) != len(weights):
        raise ValueError("one weight per block is needed")
    if not all(isinstance(w, (int, float)) for w in weights):
        raise ValueError("weights must be numbers")
    if abs(sum(weights) - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")
    return F.concat(*[scale(b, w) for b, w in zip(blocks, weights)])


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def mean_vector(v: Column, weight: Column | None = None) -> Column:
    """Aggregate: (weighted) mean; partial sums are combined map-side."""
    packed = array_to_vector(doubles(v))
    return vector_to_array(Summarizer.mean(packed, weight) if weight is not None else Summarizer.mean(packed))


def sum_vector(v: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(doubles(v))))


def max_vector(v: Column) -> Column:
    return vector_to_array(Summarizer.max(array_to_vector(doubles(v))))
