"""Streams as text keys, and joins on keys that may be very common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.tables import discard, stored

#: A key is common where it holds at least one in so many of the rows: there are never more common keys than that.
COMMON = 1000


def key_of(stream: Column) -> Column:
    """A key that is never null, and differs where streams do."""
    return F.coalesce(F.concat(F.lit("="), stream.cast("string")), F.lit(""))


def stream_of(key: Column, kind) -> Column:
    """The stream of a key."""
    return F.when(key != "", F.substr(key, F.lit(2))).cast(kind)


def tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def by_size(df: DataFrame, stream: str, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of streams of up to so many rows, and those of larger ones; None where there are none."""
    if df.count() <= most:
        return df, None
    sizes = stored(df.groupBy(key_of(F.col(stream)).alias("_k")).agg((F.count("*") > most).alias("_large")), "curve-sizes")
    kinds = {r[0] for r in sizes.select("_large").distinct().collect()}
    if len(kinds) < 2:
        discard(sizes)
        return (None, df) if kinds == {True} else (df, None)
    own = df.withColumn("_k", key_of(F.col(stream))).join(sizes, "_k")
    return tuple(own.where(F.col("_large") == large).select(df.columns) for large in (False, True))


def join_common(rows: DataFrame, table: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` joined by ``on`` with a table of one row for each key, whose column ``n`` says how many rows have the key
    and isn't passed on.  Rows of common keys stay where they are and get the table's few rows for them (at most COMMON)
    by broadcast; only the others are dealt by key."""
    common = F.col("n") * COMMON >= F.lit(max(1, total))
    few, rest = table.where(common).drop("n"), table.where(~common).drop("n")
    here = rows.join(F.broadcast(few), on)
    return here.unionByName(rows.join(F.broadcast(few.select(on)), on, "left_anti").join(rest, on))
