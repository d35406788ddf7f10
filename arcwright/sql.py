"""SQL over curves: functions of positions and velocities as arrays, and orders as table functions.

``register`` makes them for a session.  The functions are SQL themselves, so they stay inside Spark's expressions; a walk
is a Python table function whose argument is a table, partitioned by its stream::

    SELECT * FROM walk_order(TABLE(points) PARTITION BY (stream_id), 'aligned', 1.0D, 1e300D)

Columns are those of the spec; a stream's rows meet in one task, as for ``order``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from arcwright.functions.metrics import AlignedMomentum, FullPhaseSpace, Spatial
from arcwright.operators.walk import WalkConfig, checked, steps
from arcwright.spec import Spec

METRICS = {"spatial": Spatial, "aligned": AlignedMomentum, "full": FullPhaseSpace}

#: name, arguments, type and body of each function; a and b are arrays of components.
FUNCTIONS: list[tuple[str, str, str, str]] = [
    ("phase_dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("phase_norm", "a ARRAY<DOUBLE>", "DOUBLE", "sqrt(phase_dot(a, a))"),
    ("phase_distance", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "phase_norm(zip_with(a, b, (x, y) -> x - y))"),
    ("phase_unit", "a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(a, x -> CASE WHEN aggregate(a, 0D, (s, y) -> s + y * y) <> 0D THEN x / sqrt(aggregate(a, 0D, (s, y) -> s + y * y)) ELSE 0D END)"),
    ("phase_direction", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "phase_unit(zip_with(a, b, (x, y) -> y - x))"),
    ("phase_cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "phase_dot(phase_unit(a), phase_unit(b))"),
    ("metric_spatial", "q0 ARRAY<DOUBLE>, v0 ARRAY<DOUBLE>, q ARRAY<DOUBLE>, v ARRAY<DOUBLE>, scale DOUBLE", "DOUBLE", "phase_distance(q0, q)"),
    ("metric_aligned", "q0 ARRAY<DOUBLE>, v0 ARRAY<DOUBLE>, q ARRAY<DOUBLE>, v ARRAY<DOUBLE>, scale DOUBLE", "DOUBLE", "phase_distance(q0, q) + scale * (1D - phase_dot(phase_unit(v0), phase_direction(q0, q)))"),
    ("metric_full", "q0 ARRAY<DOUBLE>, v0 ARRAY<DOUBLE>, q ARRAY<DOUBLE>, v ARRAY<DOUBLE>, scale DOUBLE", "DOUBLE", "sqrt(pow(phase_distance(q0, q), 2) + pow(scale * phase_distance(v0, v), 2))"),
]


def walk_function(spec: Spec):
    """A table function from a table, and the name of a metric, its scale and max_dist if they aren't the defaults, to
    stream, idx, ord: ord counts visits from 0, and is null for skipped points."""

    class WalkOrder:
        @staticmethod
        def analyze(table: AnalyzeArgument, metric: AnalyzeArgument | None = None, scale: AnalyzeArgument | None = None, max_dist: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the first argument must be a TABLE, partitioned by its stream")
            if missing := [c for c in spec.columns if c not in table.dataType.names]:
                raise ValueError(f"the table has no columns {missing}")
            if metric is not None and metric.value not in METRICS:
                raise ValueError(f"the metric must be one of {sorted(METRICS)}")
            if max_dist is not None and not (max_dist.value is not None and float(max_dist.value) > 0):
                raise ValueError("max_dist must be positive")
            schema = StructType().add(table.dataType[spec.stream]).add(spec.idx, LongType()).add("ord", LongType())
            return AnalyzeResult(schema=schema)

        def __init__(self) -> None:
            self.rows, self.options = [], ("aligned", 1.0, float("inf"))

        def eval(self, row, metric="aligned", scale=1.0, max_dist=float("inf")):
            self.options = (metric, float(scale), float(max_dist))
            self.rows.append(tuple(row[c] for c in spec.columns))

        def terminate(self):
            if not self.rows:
                return
            metric, scale, far = self.options
            rows = pd.DataFrame(self.rows, columns=spec.columns)
            if rows[spec.stream].nunique(dropna=False) > 1:
                raise ValueError(f"the table must be partitioned by {spec.stream}")
            pdf, q, v = checked(rows, spec)
            path = steps(q, v, 0, WalkConfig(METRICS[metric]()), scale, far, set(), len(q))
            place = np.full(len(q), -1)
            place[path] = np.arange(len(path))
            stream = self.rows[0][0]
            for i, p in zip(pdf[spec.idx].tolist(), place.tolist()):
                yield stream, int(i), p if p >= 0 else None

    return WalkOrder


def register(spark: SparkSession, spec: Spec | None = None) -> None:
    """Makes the functions for this session: scalars, metrics, and walk_order for tables with the columns of the spec."""
    from pyspark.sql.functions import udtf

    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("walk_order", udtf(walk_function(spec or Spec())))
