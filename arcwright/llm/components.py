"""Joins on keys that may be very common, and connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: A key is heavy where it holds at least one in so many of the rows: there are never more heavy keys than that.
HEAVY = 1000
#: Edges up to which one task joins them all: 16 bytes each.  The edges are counted first.
AT_ONCE = 1 << 20


def join_heavy(rows: DataFrame, table: DataFrame, on: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``on`` with a table of one row for each key, whose column ``n`` says how many rows have the key
    and isn't passed on.  The heavy keys' rows stay where they are and get the table's few rows for them by broadcast (at
    most HEAVY); only the others are dealt, and none of their keys holds more than a share of 1 / HEAVY."""
    heavy = F.col("n") * HEAVY >= F.lit(max(1, total))
    few, rest = table.where(heavy).drop("n"), table.where(~heavy).drop("n")
    here = rows.join(F.broadcast(few), on)
    dealt = rows.join(F.broadcast(few.select(on)), on, "left_anti").join(rest, on, how)
    return here.unionByName(dealt)


def _large(e: DataFrame, total: int) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    return join_heavy(both, least, "a", 2 * total).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame, total: int) -> DataFrame:
    """The node and its smaller neighbours move to the smallest of them (a > b in each edge)."""
    least = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_heavy(e, least, "a", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of edges, and the least id that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(at, 2)
    of = np.arange(len(ids))
    while True:
        x, y = of[a], of[b]
        differ = x != y
        if not differ.any():
            return ids, ids[of]
        np.minimum.at(of, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (of[of] != of).any():
            of = of[of]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    parts = [(none, none), *((x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches)]
    ids, least = least_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["id", "component"])


def connected(edges: DataFrame, name: str, at_once: int = AT_ONCE) -> DataFrame:
    """id, component: the smallest id reachable, for each id that an edge (a, b) between different ids names.

    Nulls and loops are no edges.  Up to ``at_once`` edges go through one task.  More are contracted in the cluster: a
    round halves paths, so rounds grow with the logarithm of the longest path; each step is written to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct()
    e = stored(e, name)
    if e.count() <= at_once:
        return e.repartition(1).mapInArrow(_at_once, "id long, component long")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a")).first()
        if now == mark or not now[0]:
            break
        mark = now
        grown = stored(_large(e, now[0]).distinct(), name)
        e, before = stored(_small(grown, now[0]), name), e
        discard(before)
        discard(grown)
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
