"""Vector expressions: activations, products and normalisation on array<double> columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def relu(x: Column) -> Column:
    """max(x, 0), and never a negative zero."""
    return F.when(x > 0, x).otherwise(F.lit(0.0))


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(slope) * x)


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def scaled(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda v: v * factor)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def product(vector: Column, weights: Sequence[Sequence[float]]) -> Column:
    """vector (k) times weights (k x m): one dot product with each weight column."""
    columns = list(zip(*weights, strict=True))
    return F.transform(F.array(*map(literal, columns)), lambda w: dot(vector, w))


def dropout(vector: Column, rate: float) -> Column:
    """The vector itself: inference drops nothing, whatever the rate."""
    if not 0 <= rate < 1:
        raise ValueError("a dropout rate lies in [0, 1)")
    return vector


def pack(columns: Sequence[str], arrays: bool) -> Column:
    """One vector of feature segments: lists are concatenated, scalar columns are collected in order."""
    if arrays:
        return F.concat(*(F.col(c).cast("array<double>") for c in columns))
    return F.array(*(F.col(c).cast("double") for c in columns))


def inverse_degree(degree: Column, power: float = 1.0) -> Column:
    """degree (at least 1) to the power -1 or -1/2."""
    d = F.greatest(F.coalesce(degree, F.lit(0)), F.lit(1)).cast("double")
    return 1 / d if power == 1.0 else 1 / F.sqrt(d)


def binned(x: Column) -> Column:
    """Steps of 1e-6 whose edges lie off the decimal grid, so engines that sum in another order agree."""
    return F.floor(x * F.lit(1e6) + F.lit(0.3183098861837907)).cast("double") / F.lit(1e6) + F.lit(0.0)


def padded(vector: Column, width: int) -> Column:
    """The vector filled up with zeros to ``width``, and its own length behind."""
    short = F.greatest(F.lit(width) - F.size(vector), F.lit(0))
    return F.concat(vector, F.array_repeat(F.lit(0.0), short), F.array(F.size(vector).cast("double")))
