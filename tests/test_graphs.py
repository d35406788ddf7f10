"""Trees, components and backbones by joins against those of a task."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwright.operators import backbone, graphs, mst
from arcwright.operators.ranges import Ranges, medians
from arcwright.spec import Spec
from arcwright.tables import fresh_path

S = Spec()


def _nodes(df):
    return df.select(F.struct("_k", F.col("a").alias("_i")).alias("a"), F.struct("_k", F.col("b").alias("_i")).alias("b"), "w")


def test_forests_of_random_graphs(spark):
    """20 graphs with ties, side by side, against sorting all edges."""
    rows, want = [], set()
    for g in range(20):
        r = np.random.default_rng(g)
        n = int(r.integers(2, 40))
        pairs = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, n, (3 * n, 2)).tolist() if a != b})
        w = r.integers(0, 5, len(pairs)).astype(float) if g % 2 else r.random(len(pairs))
        rows += [(f"={g}", a, b, float(x)) for (a, b), x in zip(pairs, w, strict=True)]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        want |= {(f"={g}", *pairs[e], float(w[e])) for e in mst.spanning_tree(n, a, b, w).tolist()}
    df = spark.createDataFrame(rows, "_k string, a long, b long, w double")
    assert {(x._k, x.lo, x.hi, x.w) for x in backbone.forest(df).collect()} == want


def test_forest_of_a_long_chain(spark):
    """Weights that grow along a chain: every component points at the one before it."""
    df = spark.range(3000).selectExpr("'=c' as _k", "id as a", "id + 1 as b", "cast(id as double) as w")
    assert backbone.forest(df).count() == 3000


def test_components_of_a_long_path(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("=p").alias("_k"), F.col("id").alias("i")).select("_k", F.pmod(F.col("i") * 31, F.lit(n + 1)).alias("a"), F.pmod((F.col("i") + 1) * 31, F.lit(n + 1)).alias("b"), F.lit(1.0).alias("w"))
    rounds = []
    plain = graphs._large
    graphs._large = lambda *x: rounds.append(1) or plain(*x)
    try:
        found = graphs.connected(_nodes(df).drop("w"))
        assert found.count() == n + 1 and found.select("component").distinct().count() == 1
    finally:
        graphs._large = plain
    assert len(rounds) <= 30


def test_backbones_of_random_trees(spark):
    """Trees with ties and without, side by side."""
    points, rows, want = [], [], {}
    for g in range(12):
        r = np.random.default_rng(g)
        n = int(r.integers(1, 60))
        parent = [int(r.integers(max(0, i - 3), i)) for i in range(1, n)]
        w = r.integers(1, 4, n - 1).astype(float) if g % 2 else r.random(n - 1) + 0.1
        q, v = r.normal(0, 1, (n, 2)), r.normal(0, 1, (n, 2))
        a, b = np.array(parent, np.int64), np.arange(1, n)
        points += [(f"s{g}", i, *map(float, q[i]), *map(float, v[i])) for i in range(n)]
        rows += [(f"=s{g}", p, i + 1, float(w[i])) for i, p in enumerate(parent)]
        order, path = mst.backbone(q, v, a, b, w, np.arange(n), True)
        for o, i in enumerate(order.tolist()):
            want[f"=s{g}", i] = [o, None]
        for o, i in enumerate(path.tolist()):
            want[f"=s{g}", i][1] = o
    df = spark.createDataFrame(points, "stream_id string, idx long, x double, y double, vx double, vy double")
    links = spark.createDataFrame(rows, "_k string, a long, b long, w double")
    found = backbone.settle(backbone.keyed_points(df, S), 2, links, on_disconnected="raise", sigma=None, rounds=1, orient=True, least_ratio=2.0, small_share=0.01)
    got = {(x._k, x._i): [x.ord, x.vertex] for x in found.collect()}
    assert got == want


def _curves(spark):
    r = np.random.default_rng(7)
    rows = []
    for g, n in enumerate((160, 90, 1, 2)):
        t = np.sort(r.random(n)) * 6
        q = np.stack([t, np.sin(t) + r.normal(0, 0.02, n)], axis=1)
        if n > 100:
            q[-3:] += 40  # far away, behind a long link
        rows += [(f"s{g}" if g else None, int(i), *map(float, q[j]), 1.0, float(np.cos(t[j]))) for j, i in enumerate(r.permutation(n) * 2)]
    return spark.createDataFrame(rows, "stream_id string, idx long, x double, y double, vx double, vy double").repartition(5)


@pytest.mark.parametrize("options", [{"jump_cap": 100.0, "edge_clip_sigma": 4.0, "orient_by_velocity": True, "on_disconnected": "largest"}, {"jump_cap": 0.6, "on_disconnected": "largest"}])
def test_curves_over_many_tasks_equal_those_of_one(spark, options):
    """Small curves in a task, large ones by joins, in one table: as all of them in tasks.  Only results are left."""
    df = _curves(spark)
    one, two = mst.MSTOrderer(k=6, **options), mst.MSTOrderer(k=6, at_once=50, **options)
    rows = lambda t: sorted(map(repr, t.collect()))
    want = one.settle(df, S)
    here = Path(fresh_path(spark, "x").removeprefix("file://")).parent
    before = set(here.iterdir())
    got = two.settle(df, S)
    made = {p.name.rsplit("-", 1)[0] for p in set(here.iterdir()) - before}
    assert "mst-settled" in made and not any(n.startswith(("curve-t", "path-", "tour-", "graph-", "forest-")) for n in made)
    assert rows(want) == rows(got.select(want.columns))
    if "edge_clip_sigma" not in options:
        assert rows(one.tree(df, S)) == rows(two.tree(df, S))
        assert rows(one.components(df, S)) == rows(two.components(df, S))


def test_refusals_of_large_curves(spark):
    df = _curves(spark)
    with pytest.raises(ValueError, match="components"):
        mst.MSTOrderer(k=3, jump_cap=1.0, at_once=50).order(df, S)
    with pytest.raises(ValueError, match="unique"):
        mst.MSTOrderer(k=3, at_once=0).order(df.unionByName(df), S)
    with pytest.raises(ValueError, match="finite"):
        mst.MSTOrderer(k=3, at_once=0).order(df.withColumn("vx", F.lit(None).cast("double")), S)
    assert mst.MSTOrderer(at_once=0).order(df.limit(0), S).collect() == []


def test_ranges_against_lists(spark):
    r = np.random.default_rng(1)
    rows = [(k, int(o), float(x)) for k in ("", "=a", "=b") for o, x in zip(r.permutation(400), r.integers(0, 9, 400), strict=True)][: 3 * 400 - 390]
    df = spark.createDataFrame(rows, "_k string, o long, x double")
    got = Ranges(df, "_k", ["o"], 7).previous({"before": "x"}).running({"total": F.col("x")}, "rank").rows()
    by = {}
    for k, o, x in sorted(rows):
        own = by.setdefault(k, [])
        own.append((o, x, own[-1][1] if own else None, (own[-1][3] if own else 0.0) + x, len(own)))
    assert {(g._k, g.o, g.x, g.before, g.total, g["rank"]) for g in got.collect()} == {(k, *t) for k, v in by.items() for t in v}
    assert got.count() == len(rows)
    want = {k: float(np.median([t[1] for t in v])) for k, v in by.items()}
    assert {m._k: m.mid for m in medians(df, "_k", "x", "mid").collect()} == want
