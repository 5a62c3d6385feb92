"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a / |a|; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def residual(v: Column, axis: Column) -> Column:
    """What is left of v when its part along a unit axis is taken out."""
    along = dot(v, axis)
    return F.zip_with(v, axis, lambda x, a: x - along * a)
