"""Sources and sinks: phase-space tables from Parquet, from arrays, and as views of other tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.spec import Spec

#: The spec of ``tracers``.
TRACERS = Spec(q=("x", "y", "z"), v=("vx", "vy", "vz"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tracers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points of three dimensions: stream_id is the label, idx the vec_id."""
    e = F.col("embedding")
    names = [*TRACERS.q, *TRACERS.v]
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("stream_id"), F.col("vec_id").alias("idx"), *(e[i].cast("double").alias(n) for i, n in enumerate(names)))


def from_arrays(spark: SparkSession, spec: Spec, positions: dict, velocities: dict, stream="0") -> DataFrame:
    """One curve from two dicts of equal-length arrays; idx counts rows."""
    arrays = {**{c: np.asarray(positions[c], float) for c in spec.q}, **{c: np.asarray(velocities[c], float) for c in spec.v}}
    if len({len(a) for a in arrays.values()}) != 1:
        raise ValueError("components differ in length")
    n = len(next(iter(arrays.values())))
    return spark.createDataFrame(pd.DataFrame({spec.stream: [stream] * n, spec.idx: np.arange(n), **arrays}))


def write(df: DataFrame, path: str, spec: Spec) -> None:
    """Parquet, a folder for each curve."""
    df.write.partitionBy(spec.stream).parquet(path)
