"""Distances between vector columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, each) -> Column:
    return F.aggregate(F.zip_with(a, b, each), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products."""
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(_fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """1 less the cosine of the angle; null for a vector of zeros."""
    norms = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.lit(1.0) - F.when(norms > 0, inner_product(a, b) / norms)


METRICS = {"l2": l2, "cosine": cosine, "ip": lambda a, b: -inner_product(a, b)}
