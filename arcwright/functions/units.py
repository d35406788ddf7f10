"""Units in column metadata: converted by literal factors before a plan is made, and put back on its result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.functions import phasespace as P
from arcwright.spec import Spec

#: Metres, and seconds, of each unit.
LENGTHS = {"m": 1.0, "km": 1e3, "AU": 1.495978707e11, "pc": 3.0856775814913674e16, "kpc": 3.0856775814913674e19, "Mpc": 3.0856775814913674e22}
TIMES = {"s": 1.0, "yr": 31557600.0, "Myr": 31557600e6, "Gyr": 31557600e9}


def factor(unit: str) -> tuple[float, int, int]:
    """Factor to metres and seconds, and the powers of length and time, of '', a length, a time or 'length/time'."""
    if unit in ("", "1"):
        return 1.0, 0, 0
    top, _, bottom = unit.partition("/")
    if top in TIMES and not bottom:
        return TIMES[top], 0, 1
    if top in LENGTHS and (not bottom or bottom in TIMES):
        return LENGTHS[top] / (TIMES[bottom] if bottom else 1.0), 1, -1 if bottom else 0
    raise ValueError(f"unknown unit {unit!r}")


@dataclass(frozen=True)
class UnitSystem:
    length: str = "m"
    time: str = "s"

    def unit(self, powers: tuple[int, int]) -> str:
        return {(0, 0): "", (1, 0): self.length, (0, 1): self.time, (1, -1): f"{self.length}/{self.time}"}[powers]


@dataclass(frozen=True)
class Quantity:
    value: float
    unit: str

    def to(self, unit: str) -> float:
        a, *powers = factor(self.unit)
        b, *wanted = factor(unit)
        if powers != wanted:
            raise ValueError(f"{self.unit!r} is no measure of {unit!r}")
        return self.value * (a / b)


def with_unit(df: DataFrame, **units: str) -> DataFrame:
    for name, unit in units.items():
        factor(unit)
        df = df.withMetadata(name, {**df.schema[name].metadata, "unit": unit})
    return df


def unit_of(df: DataFrame, name: str) -> str:
    return df.schema[name].metadata.get("unit", "")


def converted(column: Column, unit: str, to: str) -> Column:
    ratio = Quantity(1.0, unit).to(to)
    return column if ratio == 1.0 else column * F.lit(ratio)


def stripped(df: DataFrame, spec: Spec, system: UnitSystem | None) -> DataFrame:
    """Plain numbers in the units of the system; TypeError without a system, or where a component has no unit."""
    if not isinstance(system, UnitSystem):
        raise TypeError("columns with units need a UnitSystem")
    length, speed = system.unit((1, 0)), system.unit((1, -1))
    for names, unit in ((spec.q, length), (spec.v, speed)):
        for c in names:
            if not (own := unit_of(df, c)):
                raise TypeError(f"column {c} has no unit")
            df = df.withColumn(c, converted(F.col(c).cast("double"), own, unit))
    return df


def reattached(df: DataFrame, spec: Spec, system: UnitSystem) -> DataFrame:
    units = {c: system.unit((1, 0)) for c in spec.q} | {c: system.unit((1, -1)) for c in spec.v}
    return with_unit(df, **{c: u for c, u in units.items() if c in df.columns})


def plain(x: Quantity | float, unit: str) -> float:
    """The value in the unit; TypeError for a plain number."""
    if not isinstance(x, Quantity):
        raise TypeError(f"expected a Quantity in {unit}")
    return x.to(unit)


def _vector(df: DataFrame, names: Sequence[str], unit: str | None) -> tuple[list[Column], str]:
    """Components in the unit, or in that of the first; TypeError where one has none, ValueError for another kind."""
    for c in names:
        if not unit_of(df, c):
            raise TypeError(f"column {c} has no unit")
    unit = unit or unit_of(df, names[0])
    return [converted(F.col(c).cast("double"), unit_of(df, c), unit) for c in names], unit


def _kind(unit: str, powers: list[tuple[int, int]]) -> None:
    if factor(unit)[1:] not in powers:
        raise ValueError(f"{unit!r} is of the wrong kind")


LENGTH, SPEED = (1, 0), (1, -1)


def with_distance(df: DataFrame, name: str, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """A column of Euclidean distances of positions, in the unit of the first component."""
    x, unit = _vector(df, a, None)
    _kind(unit, [LENGTH])
    return with_unit(df.withColumn(name, P.euclidean_distance(x, _vector(df, b, unit)[0])), **{name: unit})


def with_velocity_norm(df: DataFrame, name: str, v: Sequence[str]) -> DataFrame:
    """A column of speeds, in the unit of the first component."""
    x, unit = _vector(df, v, None)
    _kind(unit, [SPEED])
    return with_unit(df.withColumn(name, P.velocity_norm(x)), **{name: unit})


def with_unit_direction(df: DataFrame, names: Sequence[str], a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """Columns of the direction from a to b: plain numbers."""
    x, unit = _vector(df, a, None)
    _kind(unit, [LENGTH])
    return df.withColumns(dict(zip(names, P.unit_direction(x, _vector(df, b, unit)[0]), strict=True)))


def with_unit_velocity(df: DataFrame, names: Sequence[str], v: Sequence[str]) -> DataFrame:
    """Columns of the direction of a velocity: plain numbers."""
    x, unit = _vector(df, v, None)
    _kind(unit, [SPEED])
    return df.withColumns(dict(zip(names, P.unit_velocity(x), strict=True)))


def with_cosine(df: DataFrame, name: str, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """A column of cosines of angles between two vectors, each in units of its own kind: plain numbers."""
    return df.withColumn(name, P.cosine_similarity(_vector(df, a, None)[0], _vector(df, b, None)[0]))
