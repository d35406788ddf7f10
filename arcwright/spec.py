"""Names of the columns that make up phase space in a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """stream: the curve a row belongs to; idx: unique in it, breaks ties; q and v: position and velocity components."""

    q: tuple[str, ...] = ("x", "y")
    v: tuple[str, ...] = ("vx", "vy")
    stream: str = "stream_id"
    idx: str = "idx"

    def __post_init__(self) -> None:
        if not self.q or len(self.q) != len(self.v):
            raise ValueError("positions and velocities need the same number of components, one at least")
        if len({*self.q, *self.v, self.stream, self.idx}) != 2 * len(self.q) + 2:
            raise ValueError("column names of a spec must differ")

    @property
    def columns(self) -> list[str]:
        return [self.stream, self.idx, *self.q, *self.v]

    def position(self, prefix: str = "") -> list[Column]:
        return [F.col(prefix + c) for c in self.q]

    def velocity(self, prefix: str = "") -> list[Column]:
        return [F.col(prefix + c) for c in self.v]

    def typed(self, df):
        """Only the columns of the spec, of one type each."""
        return df.select(F.col(self.stream), F.col(self.idx).cast("long").alias(self.idx), *(F.col(c).cast("double").alias(c) for c in (*self.q, *self.v)))
