"""Ranks, previous rows and running sums along orders of any length.

Rows are dealt by ranges of (key, order), so that a range holds a bounded part of a key's rows, however many it has.
Within a range they are numbered and summed by a window; the ranges' totals, of which a key has as many as there are
ranges at most, are summed over the ranges before.  So no task holds a key's rows, and each row is read once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwright.tables import stored

from .keyed import tasks

#: How far from the middle, as a share of a key's values, those are that ``medians`` counts each.
NEAR = 0.001


class Ranges:
    """Rows of ``df`` in the order of ``order`` within the column ``key``, which is never null; rows that are equal in all
    of them lie in one range."""

    def __init__(self, df: DataFrame, key: str, order: list[str], n: int | None = None) -> None:
        self.key, self.order = key, order
        dealt = df.repartitionByRange(n or tasks(df), key, *order).withColumn("_range", F.spark_partition_id())
        self.df = stored(dealt, "ranges")

    def _new(self, df: DataFrame) -> Ranges:
        out = object.__new__(Ranges)
        out.key, out.order, out.df = self.key, self.order, df
        return out

    @property
    def _within(self):
        return Window.partitionBy(self.key, "_range").orderBy(*self.order)

    @property
    def _between(self):
        return Window.partitionBy(self.key).orderBy("_range")

    def _with_earlier(self, rows: DataFrame, totals: DataFrame) -> DataFrame:
        return rows.join(totals, [self.key, "_range"])

    def running(self, sums: dict[str, Column], rank: str | None = None) -> Ranges:
        """Adds sums of columns over all rows up to each one, and its number from 0."""
        parts = {f"_t{i}": c for i, c in enumerate(sums.values())}
        total = self.df.groupBy(self.key, "_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(n) for n, c in parts.items()))
        before = self._between.rowsBetween(Window.unboundedPreceding, -1)
        total = total.select(self.key, "_range", *(F.sum(n).over(before).alias(f"_b{n}") for n in ("_n", *parts)))
        up_to = self._within.rowsBetween(Window.unboundedPreceding, 0)
        rows = self.df.withColumns({n: F.sum(c).over(up_to) for n, c in parts.items()} | {"_n": F.row_number().over(self._within)})
        rows = self._with_earlier(rows, total)
        known = [c for c in self.df.columns if c not in sums and c != rank]
        new = [(F.coalesce(F.col(f"_b{n}"), F.lit(0)) + F.col(n)).alias(name) for name, n in zip(sums, parts, strict=True)]
        number = [(F.coalesce("_b_n", F.lit(0)) + F.col("_n") - 1).cast("long").alias(rank)] if rank else []
        return self._new(rows.select(*known, *new, *number))

    def previous(self, columns: dict[str, str]) -> Ranges:
        """Adds columns of the row before, null for the first of a key."""
        last = F.max_by(F.struct(*columns.values()), F.struct(*self.order)).alias("_last")
        ends = self.df.groupBy(self.key, "_range").agg(last).select(self.key, "_range", F.lag("_last").over(self._between).alias("_last"))
        rows = self.df.withColumns({f"_p{i}": F.lag(c).over(self._within) for i, c in enumerate(columns.values())} | {"_n": F.row_number().over(self._within)})
        rows = self._with_earlier(rows, ends)
        new = [F.when(F.col("_n") > 1, F.col(f"_p{i}")).otherwise(F.col("_last")[c]).alias(name) for i, (name, c) in enumerate(columns.items())]
        return self._new(stored(rows.select(*[c for c in self.df.columns if c not in columns], *new), "ranges"))

    def where(self, condition: str | Column) -> Ranges:
        return self._new(self.df.where(condition))

    def with_columns(self, columns: dict[str, Column]) -> Ranges:
        return self._new(self.df.withColumns(columns))

    def rows(self) -> DataFrame:
        return self.df.drop("_range")


def ranked(df: DataFrame, key: str, order: list[str], rank: str) -> DataFrame:
    """df with each row's number, from 0, in the order within its key."""
    return Ranges(df, key, order).running({}, rank).rows()


def medians(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key, name: the exact median of the values of each key (the mean of the middle two).

    Values near the middle, between quantiles whose error is a tenth of their distance from it, are counted each, so a
    task holds some thousandths of a key's distinct values at most; lesser ones are counted together."""
    near = df.groupBy(key).agg(F.percentile_approx(value, [0.5 - NEAR, 0.5 + NEAR], int(10 / NEAR)).alias("_q"), F.count(value).alias("_size"))
    rows = df.select(key, value).join(near, key).where(F.col(value) <= F.col("_q")[1])
    counts = rows.groupBy(key, "_size", F.when(F.col(value) >= F.col("_q")[0], F.col(value)).alias("_x")).agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(key).orderBy(F.asc_nulls_first("_x")))
    low, high = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    middle = counts.withColumn("_to", up_to).withColumn("_from", F.col("_to") - F.col("_n"))
    first, last = (F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("_x"))) for r in (low, high))
    return middle.groupBy(key).agg(((first + last) / 2).alias(name))
