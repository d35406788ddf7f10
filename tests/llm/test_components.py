import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwright.llm.components import connected, join_heavy


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in list(up))


@pytest.mark.parametrize("at_once", [1 << 20, 0], ids=["one task", "rounds"])
def test_components_of_paths_stars_and_odd_edges(spark, at_once):
    r = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 300)] + [(900 - i, 900) for i in range(1, 40)]
    edges += [tuple(x) for x in r.integers(2000, 2200, (90, 2)).tolist()] + [(None, 3), (4, None), (7, 7), (-5, 3), (3, -5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    assert sorted(map(tuple, connected(df, "test", at_once).collect())) == brute(edges)
    assert connected(df.limit(0), "test", at_once).collect() == []


def test_heavy_keys_stay_where_they_are(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    got = join_heavy(rows, table, "k", 5000)
    assert got.columns == ["k", "id", "most"] and got.count() == 5000
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table.drop("n"), "k").collect()))
    half = table.where("k % 2 = 0")
    assert join_heavy(rows.where("k <> 1"), half, "k", 5000, "left").where("most is null").count() == 1000
