"""Phase-space scalars as columns: each argument is a list of component columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def dot(a: Vector, b: Vector) -> Column:
    return reduce(add, [x * y for x, y in zip(a, b, strict=True)])


def difference(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def velocity_norm(v: Vector) -> Column:
    return F.sqrt(dot(v, v))


def euclidean_distance(a: Vector, b: Vector) -> Column:
    return velocity_norm(difference(a, b))


def unit_velocity(v: Vector) -> list[Column]:
    """v over its norm; zeros where the norm is 0."""
    n = velocity_norm(v)
    return [F.when(n != 0, x / n).otherwise(F.lit(0.0)) for x in v]


def unit_direction(a: Vector, b: Vector) -> list[Column]:
    """The direction from a to b; zeros where they coincide."""
    return unit_velocity(difference(b, a))


def cosine_similarity(a: Vector, b: Vector) -> Column:
    """The cosine of the angle between a and b; 0 where either is zero."""
    return dot(unit_velocity(a), unit_velocity(b))


def edge_cosine(a: Vector, b: Vector) -> Column:
    """The cosine of the angle between a and b; 0 where the product of the norms is 1e-12 at most."""
    den = velocity_norm(a) * velocity_norm(b)
    return F.when(den > 1e-12, dot(a, b) / den).otherwise(F.lit(0.0))


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def logaddexp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
