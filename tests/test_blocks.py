"""Forests, components and tours by blocks against those of a task; what clipping leaves in pieces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwright.operators import backbone, blocks, graphs, mst
from arcwright.operators.ranges import medians
from arcwright.spec import Spec

S = Spec()


def _graph(n: int, seed: int, ties: bool):
    r = np.random.default_rng(seed)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, n, (2 * n, 2)).tolist() if a != b})
    return pairs, r.integers(0, 4, len(pairs)).astype(float) if ties else r.random(len(pairs))


def _at(spark, curves: int, n: int):
    """Points in eight blocks, mostly by idx."""
    r = np.random.default_rng(3)
    return spark.createDataFrame([(f"={g}", i, int(r.integers(8)) if i % 5 == 0 else 8 * i // n) for g in range(curves) for i in range(n)], "_k string, _i long, _x long")


@pytest.mark.parametrize("bound", [1 << 19, 60, 2])
def test_forests_and_components_by_blocks(spark, monkeypatch, bound):
    """By blocks and then a curve in a task; with coarser blocks that are too large for that; by joins alone."""
    monkeypatch.setattr(graphs, "BOUND", bound)
    n, curves, rows, trees, parts = 80, 4, [], set(), set()
    for g in range(curves):
        pairs, w = _graph(n, g, g % 2 == 0)
        rows += [(f"={g}", a, b, float(x)) for (a, b), x in zip(pairs, w, strict=True)]
        a, b = np.array(pairs, np.int64).T
        trees |= {(f"={g}", *pairs[e], float(w[e])) for e in mst.spanning_tree(n, a, b, w).tolist()}
        parts |= {(f"={g}", i, int(c)) for i, c in enumerate(mst.components(n, a, b))}
    links, at = spark.createDataFrame(rows, "_k string, a long, b long, w double"), _at(spark, curves, n)
    assert {tuple(x) for x in blocks.forest(links, at).select("_k", "lo", "hi", "w").collect()} == trees
    assert {tuple(x) for x in blocks.components(at.select("_k", "_i"), links, at).select("_k", "_i", "c").collect()} == parts


@pytest.mark.parametrize("bound", [1 << 19, 20])
def test_tours_by_blocks(spark, monkeypatch, bound):
    n, curves, rows, want = 60, 3, [], set()
    for g in range(curves):
        r = np.random.default_rng(g)
        near = [[] for _ in range(n)]
        for i in range(1, n):
            p = int(r.integers(max(0, i - 4), i))
            rows.append((f"={g}", p, i, 1.0))
            near[p].append(i)
            near[i].append(p)
        near, place, u, v = [sorted(x) for x in near], {}, 0, min(near[0])
        while (u, v) not in place:
            place[u, v] = len(place)
            u, v = v, near[v][(near[v].index(u) + 1) % len(near[v])]
        want |= {(k, a, b, place[a, b], place[b, a]) for k, a, b, _ in rows if k == f"={g}"}
    tree = spark.createDataFrame(rows, "_k string, lo long, hi long, w double")
    monkeypatch.setattr(graphs, "BOUND", bound)
    for at in (None, _at(spark, curves, n)):
        assert {tuple(x) for x in graphs.tour(tree, at).select("_k", "lo", "hi", "p", "q").collect()} == want


def test_the_longest_path_of_pieces(spark):
    """Only the piece of the least node counts; a tour of several trees isn't told as one."""
    nodes = spark.createDataFrame([("=a", i) for i in range(7)] + [("=b", 1), ("=b", 2), ("=b", 3)], "_k string, _i long")
    tree = spark.createDataFrame([("=a", 0, 2, 1.0), ("=a", 2, 6, 1.0), ("=a", 1, 3, 9.0), ("=a", 3, 5, 9.0), ("=b", 2, 3, 1.0)], "_k string, lo long, hi long, w double")
    assert {tuple(x) for x in backbone.longest_path(nodes, tree).collect()} == {("=a", 6, 0), ("=a", 2, 1), ("=a", 0, 2), ("=b", 1, 0)}
    with pytest.raises(Exception, match="aren't one tree"):
        graphs.tour(tree).count()


def test_clipping_in_the_middle_of_a_curve(spark):
    """What is clipped joined two pieces: before, the walk around them had no end."""
    x = np.concatenate([np.arange(150) * 0.1, [20.0, 20.1], 25.2 + np.arange(148) * 0.1])
    x += np.random.default_rng(2).normal(0, 0.004, len(x))
    ids = np.random.default_rng(1).permutation(len(x))
    df = spark.createDataFrame([("c", int(i), float(p), 0.0, 1.0, 0.0) for i, p in zip(ids, x, strict=True)], "stream_id string, idx long, x double, y double, vx double, vy double")
    options = {"k": 6, "jump_cap": 100.0, "edge_clip_sigma": 4.0, "orient_by_velocity": True, "on_disconnected": "largest"}
    want, got = (mst.MSTOrderer(at_once=m, **options).settle(df, S).select("idx", "ord", "vertex") for m in (1000, 0))
    want = sorted(map(repr, want.collect()))
    assert sum("ord=None" in x for x in want) == 2
    assert sorted(map(repr, got.collect())) == want


def test_medians_of_many_values(spark):
    r = np.random.default_rng(4)
    values = {"=a": r.normal(0, 1, 30_001), "=b": r.integers(0, 3, 20_000).astype(float), "=c": np.arange(40_000) - 7.0, "=d": np.array([1.0, 4.0]), "=e": np.repeat([-3.0, 5.0], 5000)}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "_k string, x double").repartition(7)
    assert {m._k: m.mid for m in medians(df, "_k", "x", "mid").collect()} == {k: float(np.median(v)) for k, v in values.items()}
