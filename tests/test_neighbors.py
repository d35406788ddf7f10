"""Exact neighbours, trees and results on awkward curves, against brute force."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwright import nn
from arcwright.functions.units import Quantity, UnitSystem, unit_of, with_unit
from arcwright.operators import neighbors, results, walk
from arcwright.operators.mst import MSTOrderer
from arcwright.spec import Spec

S = Spec()


def table(spark, q, v=None, stream="s"):
    v = np.ones_like(q) if v is None else v
    return spark.createDataFrame([(stream, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(q, v, strict=True))], "stream_id string, idx long, x double, y double, vx double, vy double")


def brute(q, k):
    out = set()
    for i in range(len(q)):
        d = np.sqrt((q[:, 0] - q[i, 0]) ** 2 + (q[:, 1] - q[i, 1]) ** 2)
        d[i] = np.inf
        for r, j in enumerate(np.lexsort((np.arange(len(q)), d))[: min(k, len(q) - 1)]):
            out.add((i, int(j), round(float(d[j]), 9), r + 1))
    return out


def found(df, k, leaf=None):
    return {(r.idx, r.neighbor, round(r.distance, 9), r["rank"]) for r in neighbors.knn(df, S, k, leaf).collect()}


@pytest.mark.parametrize("leaf", [None, 20], ids=["at once", "in leaves"])
def test_knn_against_brute_force(spark, leaf):
    r = np.random.default_rng(2)
    q = np.concatenate([r.normal(0, 1, (150, 2)), r.normal(5, 0.01, (80, 2)), np.zeros((30, 2)), r.integers(0, 4, (40, 2)), [[1e6, 1e6], [-3e5, 2.0]]])
    assert found(table(spark, q), 5, leaf) == brute(q, 5)
    assert found(table(spark, q[:3]), 5, 1) == brute(q[:3], 5)
    assert found(table(spark, q[:1]), 5, leaf) == set()


def test_large_and_small_curves_side_by_side(spark):
    """Curves that are cut into leaves, one of them without a name, and one that isn't."""
    r = np.random.default_rng(12)
    curves = {"it's": r.normal(0, 1, (300, 2)), None: np.concatenate([r.normal(0, 1e-3, (150, 2)), r.normal(0, 1, (50, 2)), np.ones((20, 2))]), "b": r.normal(0, 1, (10, 2))}
    df = None
    for key, q in curves.items():
        own = table(spark, q, stream=key)
        df = own if df is None else df.unionByName(own)
    rows = neighbors.knn(df.repartition(6), S, 4, 40).collect()
    for key, q in curves.items():
        assert {(x.idx, x.neighbor, round(x.distance, 9), x["rank"]) for x in rows if x.stream_id == key} == brute(q, 4)


@pytest.mark.parametrize("seed", range(6))
def test_cells_against_sorting(seed):
    r = np.random.default_rng(seed)
    p = np.concatenate([r.normal(0, 1, (400, 3)), r.normal(0, 1e-4, (300, 3)), r.integers(0, 3, (200, 3))]).astype(float)
    ids = r.permutation(len(p)) * 3
    q = np.concatenate([p[:100], r.normal(0, 3, (150, 3)), r.integers(0, 3, (40, 3))])
    d = neighbors.distances(q, p)
    for k in (1, 4, 1000):
        n, got = neighbors.nearest(q, None, p, ids, k)
        for i in range(len(q)):
            want = np.lexsort((ids, d[i]))[:k]
            assert n[i][: len(want)].tolist() == ids[want].tolist() and got[i][: len(want)].tolist() == d[i][want].tolist()
            assert not np.isfinite(got[i][len(want) :]).any()
    far, last = np.full(len(q), 1.0), np.full(len(q), 300)
    n, got = neighbors.nearest(q, None, p, ids, 5, far, last)
    for i in range(len(q)):
        want = [j for j in np.lexsort((ids, d[i])) if (d[i][j], ids[j]) < (1.0, 300)][:5]
        assert n[i][np.isfinite(got[i])].tolist() == ids[want].tolist()


@pytest.mark.parametrize("leaf", [None, 16])
def test_nearest_vertices(spark, leaf):
    r = np.random.default_rng(8)
    v = np.concatenate([np.stack([np.linspace(0, 9, 60), np.zeros(60)], axis=1), [[3.0, 3.0]] * 4])
    q = np.concatenate([r.normal(4, 3, (300, 2)), [[1.0, 1.0]] * 50, [[500.0, 1.0]], v[:5]])
    points = spark.createDataFrame([("=s", i, *map(float, x)) for i, x in enumerate(q)] + [("=none", 0, 1.0, 1.0)], "_k string, _i long, x double, y double")
    vertices = spark.createDataFrame([("=s", i, *map(float, x)) for i, x in enumerate(v)], "_k string, _n long, x double, y double")
    got = {r._i: (r._n, r._d) for r in neighbors.nearest_vertex(points, vertices, ["x", "y"], leaf).collect()}
    d = neighbors.distances(q, v)
    assert got == {i: (int(d[i].argmin()), float(d[i].min())) for i in range(len(q))}


def test_many_coinciding_points_and_a_far_one(spark):
    n = 20_000
    df = spark.range(n).selectExpr("'s' as stream_id", "id as idx", "1.0D as x", "2.0D as y", "0.0D as vx", "0.0D as vy")
    df = df.unionByName(spark.createDataFrame([("s", n, 1e9, 1e9, 0.0, 0.0)], df.schema))
    got = neighbors.knn(df, S, 3)
    assert got.count() == 3 * (n + 1)
    first = {r.idx: r.ids for r in got.groupBy("idx").agg(F.array_sort(F.collect_list("neighbor")).alias("ids")).collect()}
    assert all(first[i] == [j for j in range(4) if j != i][:3] for i in range(n + 1))


def test_null_streams_and_missing_positions(spark):
    rows = [(None, 0, 0.0, 0.0), (None, 1, 1.0, 0.0), ("a", 0, 0.0, 0.0), ("a", 1, 0.5, 0.0), ("a", 2, None, 0.0), ("a", 3, math.nan, 0.0)]
    df = spark.createDataFrame([(*r, 1.0, 1.0) for r in rows], "stream_id string, idx long, x double, y double, vx double, vy double")
    assert sorted((str(r.stream_id), r.idx, r.neighbor) for r in neighbors.knn(df, S, 2).collect()) == [("None", 0, 1), ("None", 1, 0), ("a", 0, 1), ("a", 1, 0)]
    assert neighbors.knn(df.limit(0), S, 2).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_tree_of_points_against_sorting(seed):
    r = np.random.default_rng(seed)
    q = np.concatenate([r.normal(0, 1, (200, 3)), np.repeat(r.normal(0, 1, (3, 3)), 15, axis=0), r.integers(0, 3, (60, 3))]).astype(float)
    tree = walk.KDTree(q)
    for i in r.integers(0, len(q), 40).tolist():
        d = walk.lengths(q - q[i])
        for k in (1, 7, 400):
            assert tree.query(q[i], k).tolist() == np.lexsort((np.arange(len(q)), d))[:k].tolist()


def test_steps_by_the_tree_equal_sorting(spark):
    r = np.random.default_rng(1)
    q, v = r.normal(0, 1, (80, 2)), r.normal(0, 1, (80, 2))
    path = walk.steps(q, v, 0, walk.WalkConfig(strategy=walk.Nearest(6)), 1.0, np.inf, set(), 80)

    class Sorted(walk.Strategy):
        def candidates(self, state, current, q):
            d = walk.lengths(q - q[current])
            d[current] = np.inf
            return np.lexsort((np.arange(len(d)), d))[:6]

    assert path == walk.steps(q, v, 0, walk.WalkConfig(strategy=Sorted()), 1.0, np.inf, set(), 80)


LINE = np.array([[i, 0.1 * i] for i in range(5)])


def test_combined_walks(spark):
    df = table(spark, LINE, np.array([[1.0, 0.1]] * 5))
    one, two = (walk.LocalFlowOrderer(0.5, start=2, direction=d).result(df, S) for d in ("forward", "backward"))
    both = walk.combine(one, two)
    assert [r.idx for r in both.visited.orderBy("ord").collect()] == [4, 3, 0, 1, 2] and both.gamma_range == (-1.0, 1.0)
    null = df.withColumn("stream_id", F.lit(None).cast("string"))
    one, two = (walk.LocalFlowOrderer(0.5, start=2, direction=d).order(null, S) for d in ("forward", "backward"))
    assert sorted((r.idx, r.ord) for r in walk.combine_results(one, two, S).collect()) == [(0, 2), (1, 3), (2, 4), (3, 1), (4, 0)]
    fewer = walk.LocalFlowOrderer(0.5, start=2).order(df.where("idx < 4"), S)
    with pytest.raises(Exception, match="same rows"):
        walk.combine_results(walk.LocalFlowOrderer(0.5, start=2, direction="backward").order(df, S), fewer, S).collect()
    moved = walk.LocalFlowOrderer(0.5, start=2, direction="backward").result(df.withColumn("x", F.col("x") + 1), S)
    with pytest.raises(Exception, match="same rows"):
        walk.combine(walk.LocalFlowOrderer(0.5, start=2).result(df, S), moved).order.collect()


def test_results_interpolate_on_the_backbone(spark):
    q = np.concatenate([np.array([[i, 0.0] for i in range(9)]), [[4.0, 0.6]]])
    result = MSTOrderer(k=5, jump_cap=3.0, orient_by_velocity=True).result(table(spark, q, np.array([[1.0, 0.0]] * 10)), S)
    assert result.counts.first().n_visited == 10 and result.gamma_range == (-1.0, 1.0)
    asked = spark.createDataFrame([("s", g) for g in (-1.0, -0.5, 0.0, 1.0)], "stream_id string, gamma double")
    assert sorted((r.gamma, round(r.x, 9), round(r.y, 9)) for r in result(asked).collect()) == [(-1.0, 0.0, 0.0), (-0.5, 2.0, 0.0), (0.0, 4.0, 0.0), (1.0, 8.0, 0.0)]
    with pytest.raises(Exception, match="gamma must be in"):
        result(spark.createDataFrame([("s", 1.1)], "stream_id string, gamma double")).collect()
    empty = results.Ordering(result.points, result.order, S, (-1.0, 1.0), result.vertices.limit(0))
    with pytest.raises(Exception, match="empty"):
        empty(asked).collect()
    with pytest.raises(ValueError, match="gamma_range"):
        results.Ordering(result.points, result.order, S, (1.0, 1.0))


def test_trees_in_pieces(spark):
    q = np.concatenate([np.array([[i, 0.0] for i in range(8)]), np.array([[100.0 + i, 0.0] for i in range(3)])])
    df = table(spark, q)
    with pytest.raises(Exception, match="components"):
        MSTOrderer(k=2).order(df, S).collect()
    with pytest.warns(UserWarning, match="s into 2"):
        order = MSTOrderer(k=2, on_disconnected="warn").order(df, S)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        largest = MSTOrderer(k=2, on_disconnected="largest").order(df, S)
    assert sorted(map(str, order.collect())) == sorted(map(str, largest.collect()))
    assert largest.where("ord is not null").count() == 8


def test_units_of_trees_and_interpolation(spark):
    df = with_unit(table(spark, 1000 * LINE, np.array([[1.0, 0.1]] * 5)), x="pc", y="pc", vx="km/s", vy="km/s")
    system = UnitSystem("kpc", "Myr")
    order = walk.order(df, S, MSTOrderer(k=2, jump_cap=Quantity(2000.0, "pc"), velocity_weight=Quantity(0.0, "pc")), units=system)
    assert [r.idx for r in results.visited(order).orderBy("ord").collect()] in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0])
    with pytest.raises(TypeError):
        walk.order(df, S, MSTOrderer(k=2, jump_cap=2.0), units=system)
    at = results.interpolate(df, order, spark.createDataFrame([("s", 0.5)], "stream_id string, gamma double"), S)
    assert unit_of(at, "x") == "pc" and at.first().x == 2000.0


def test_running_mean_decoder():
    net = nn.OrderingNet(4, np.random.default_rng(0), 8, 1)
    ws = np.random.default_rng(1).normal(0, 1, (50, 4))
    gamma, p = net(ws)
    made = nn.RunningMeanDecoder.make(net, ws, 0.2, float(np.median(p)))
    member = p >= np.median(p)
    for g in gamma[:10]:
        near = member & (np.abs(gamma - g) < 0.1)
        assert np.allclose(made(np.array([g]))[0], ws[near, :2].sum(axis=0) / (near.sum() + 1e-10))
    with pytest.raises(ValueError, match="range"):
        made(np.array([gamma.max() + 0.01]))
    with pytest.raises(ValueError, match="no points"):
        nn.RunningMeanDecoder()(np.zeros(1))
    assert not nn.RunningMeanDecoder.make(net, ws, 0.2, 2.0)(gamma[:3]).any()
