"""Tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Where it is unset and all runs on one machine, as in tests, a folder of our
    own; on a cluster that is an error, as each executor would write to a disk of its own."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not (told := getattr(spark, "_own_tables", None)):
            told = spark._own_tables = "file://" + tempfile.mkdtemp(prefix="tables-")
    return told


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this session's part of the shared folder."""
    if not (session := getattr(spark, "_own_part", None)):
        session = spark._own_part = f"session-{uuid.uuid4().hex}"
    return f"{shared_dir(spark).rstrip('/')}/{session}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written and read again: later steps don't repeat earlier ones, nor do lost executors make them."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    if scopes := getattr(df.sparkSession, "_table_scopes", None):
        scopes[-1].append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the tables that are stored within, but those that the yielded function stores, when it ends: what is left
    of a step of many tables is its result."""
    scopes = spark.__dict__.setdefault("_table_scopes", [])
    own: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        own.remove(out._path)
        if len(scopes) > 1:
            scopes[-2].append(out._path)
        return out

    scopes.append(own)
    try:
        yield keep
    finally:
        scopes.pop()
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` returned and that nothing needs any more."""
    _delete(df.sparkSession, df._path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this session; results that are read from them must have been written or collected."""
    if session := getattr(spark, "_own_part", None):
        _delete(spark, f"{shared_dir(spark).rstrip('/')}/{session}")
