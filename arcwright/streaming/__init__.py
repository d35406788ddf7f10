"""Streams of points: encoded by models, or given their posterior membership, batch for batch.

Models lie in a store, a folder of versions of which the last complete one counts.  Each micro-batch joins the models as
they are then, by stream, so they can be replaced while a query runs, and are neither collected nor sent to all workers.
``encode_stream`` is for few small models that don't change: it sends them to all workers and needs no sink.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcwright import nn
from arcwright.spec import Spec

#: Models of at most so many bytes are sent to all workers; more need a store.
MODEL_BYTES = 256 << 20


class ModelStore:
    """Tables of models (stream, model) under a path that driver and executors share, as versions 1, 2, and so on.

    One writer at a time; a version counts once its files are complete, and readers of older ones are left alone."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """The complete versions, in order."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        found = [int(n.removeprefix("version-")) for n in names if n.startswith("version-")]
        return sorted(v for v in found if fs.exists(jvm.Path(f"{self.path}/version-{v}/_SUCCESS")))

    def put(self, models: DataFrame) -> int:
        """Writes the models as the next version, and returns its number."""
        version = max(self.versions(), default=0) + 1
        models.write.mode("overwrite").parquet(f"{self.path}/version-{version}")
        return version

    def latest(self) -> DataFrame:
        if not (known := self.versions()):
            raise ValueError(f"no models in {self.path}")
        return self.spark.read.parquet(f"{self.path}/version-{known[-1]}")


def score_stream(points: DataFrame, store: ModelStore, spec: Spec, sink: Callable[[DataFrame, int], None], checkpoint: str, *, posterior: bool = True, background_density: float | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that gives each micro-batch of points, scored by the store's models of the moment, to the sink.

    Rows are stream, idx, gamma, prob, and the posterior if asked for (by models trained with a mixture; with the given
    density of the background, or each model's own).  Rows of streams without a model go.  A batch may come again after a
    failure, with the same number: the sink should write it so that this does no harm."""

    def score(batch: DataFrame, number: int) -> None:
        models = store.latest()
        sink(nn.posterior(batch, models, spec, background_density) if posterior else nn.encode(batch, models, spec), number)

    writer = points.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def encode_stream(points: DataFrame, models: DataFrame, spec: Spec) -> DataFrame:
    """stream, idx, gamma, prob of a streaming (or other) table, without state; rows of other streams than the models' go."""
    size = models.agg(F.sum(F.length("model"))).first()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"models of {size} bytes are too large to send; use score_stream")
    sent = points.sparkSession.sparkContext.broadcast({r[0]: bytes(r[1]) for r in models.select(spec.stream, "model").collect()})
    kind = points.schema[spec.stream].dataType.simpleString()

    def run(parts):
        known = {k: pickle.loads(m) for k, m in sent.value.items()}
        for pdf in parts:
            for key, rows in pdf.groupby(spec.stream, dropna=False):
                if (m := known.get(None if pd.isna(key) else key)) is not None:
                    ws = (rows[[*spec.q, *spec.v]].to_numpy(float) - m["mean"]) / m["std"]
                    gamma, p = m["encoder"](np.asarray(ws))
                    yield pd.DataFrame({spec.stream: rows[spec.stream], spec.idx: rows[spec.idx], "gamma": gamma, "prob": p})

    return spec.typed(points).mapInPandas(run, f"`{spec.stream}` {kind}, `{spec.idx}` long, gamma double, prob double")
