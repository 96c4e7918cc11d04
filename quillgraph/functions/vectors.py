"""Dense vectors and class distributions as array expressions: no shuffle, no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def shannon_entropy(probs: Column, floor: float = 1e-12) -> Column:
    return total(F.transform(probs, lambda p: F.when(p > floor, -p * F.ln(p)).otherwise(0.0)))
