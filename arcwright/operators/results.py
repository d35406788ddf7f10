"""Views of an order (stream, idx, ord) and interpolation along it; all of it joins and aggregates."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.functions.units import unit_of, with_unit
from arcwright.spec import Spec


class Curve(ABC):
    """What gives positions at a coordinate gamma along each curve, within a range."""

    gamma_range: tuple[float, float]

    @abstractmethod
    def __call__(self, gammas: DataFrame) -> DataFrame:
        """gammas (stream, gamma) with positions; a gamma outside the range is an error."""


@dataclass(frozen=True)
class Ordering(Curve):
    """Points, their order (stream, idx, ord), the range of gamma, and the vertices of the backbone if there is one."""

    points: DataFrame
    order: DataFrame
    spec: Spec
    gamma_range: tuple[float, float] = (0.0, 1.0)
    vertices: DataFrame | None = None

    def __post_init__(self) -> None:
        if not self.gamma_range[1] > self.gamma_range[0]:
            raise ValueError("gamma_range must go from a lesser to a greater number")

    @property
    def visited(self) -> DataFrame:
        return visited(self.order)

    @property
    def skipped(self) -> DataFrame:
        return skipped(self.order)

    @property
    def counts(self) -> DataFrame:
        return counts(self.order, self.spec)

    @property
    def ordered(self) -> DataFrame:
        return ordered(self.points, self.order, self.spec)

    def __call__(self, gammas: DataFrame) -> DataFrame:
        """Along the backbone if there is one, else along the points in order."""
        return interpolate(self.points, self.order if self.vertices is None else self.vertices, gammas, self.spec, self.gamma_range)


def visited(result: DataFrame) -> DataFrame:
    return result.where("ord is not null")


def skipped(result: DataFrame) -> DataFrame:
    return result.where("ord is null").drop("ord")


def counts(result: DataFrame, spec: Spec) -> DataFrame:
    """stream, n_visited, n_skipped, all_visited."""
    return result.groupBy(spec.stream).agg(F.count("ord").alias("n_visited"), F.count(F.when(F.col("ord").isNull(), 1)).alias("n_skipped"), (F.count("ord") == F.count("*")).alias("all_visited"))


def ordered(df: DataFrame, result: DataFrame, spec: Spec) -> DataFrame:
    """The rows of df that the order visits, with ord."""
    r = result.where("ord is not null").select(F.col(spec.stream).alias("_s"), F.col(spec.idx).alias("_i"), "ord")
    return df.join(r, F.col(spec.stream).eqNullSafe(F.col("_s")) & (F.col(spec.idx) == F.col("_i"))).drop("_s", "_i")


def at(df: DataFrame, spec: Spec, idx: list[int]) -> DataFrame:
    """The rows with these idx."""
    return df.where(F.col(spec.idx).isin(idx))


def interpolate(df: DataFrame, result: DataFrame, gammas: DataFrame, spec: Spec, gamma_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """gammas (stream, gamma) with the positions at gamma, even in rank between the first and last point of the order.

    A gamma outside the range is an error, and so is a stream of gammas without visited points.  With the vertices of a
    backbone for the result, positions are on the backbone.  Units of the components go on to the positions.
    """
    low, high = gamma_range
    points = ordered(df, result, spec).select(F.col(spec.stream).alias("_s"), "ord", *spec.q)
    sizes = points.groupBy("_s").agg(F.count("*").alias("_n"))
    g = gammas.select(spec.stream, "gamma").join(sizes, F.col(spec.stream).eqNullSafe(F.col("_s")), "left").drop("_s")
    outside = (F.col("gamma") < low) | (F.col("gamma") > high) | F.col("gamma").isNull() | F.isnan("gamma")
    place = F.when(outside, F.raise_error(F.lit(f"gamma must be in [{low}, {high}]")).cast("double"))
    place = place.when(F.col("_n").isNull(), F.raise_error(F.lit("the order is empty")).cast("double"))
    g = g.withColumn("_f", place.otherwise((F.col("gamma") - low) / F.lit(high - low) * (F.col("_n") - 1)))
    g = g.withColumns({"_lo": F.least(F.floor("_f"), F.col("_n") - 1), "_hi": F.least(F.ceil("_f"), F.col("_n") - 1)})
    for side in ("lo", "hi"):  # left joins: an inner one with an empty order would have no row to raise the error
        p = points.select(F.col("_s"), F.col("ord").alias("_o"), *(F.col(c).alias(f"_{side}_{c}") for c in spec.q))
        g = g.join(p, F.col(spec.stream).eqNullSafe(F.col("_s")) & (F.col(f"_{side}") == F.col("_o")), "left").drop("_s", "_o")
    w = F.col("_f") - F.floor("_f")
    out = g.select(spec.stream, "gamma", *(((F.lit(1.0) - w) * F.col(f"_lo_{c}") + w * F.col(f"_hi_{c}")).alias(c) for c in spec.q))
    return with_unit(out, **{c: u for c in spec.q if (u := unit_of(df, c))})
