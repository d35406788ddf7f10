"""Orders of small and generated curves: what a walk and a tree have to find in them."""

import numpy as np
import pytest

from arcwright.operators import results, statistics
from arcwright.operators.mst import MSTOrderer
from arcwright.operators.walk import LocalFlowOrderer, order
from arcwright.sources import from_arrays
from arcwright.spec import Spec

ONE, TWO, THREE = Spec(("x",), ("vx",)), Spec(), Spec(("x", "y", "z"), ("vx", "vy", "vz"))


def curve(spark, spec, q, v):
    q, v = np.asarray(q, float), np.asarray(v, float)
    return from_arrays(spark, spec, dict(zip(spec.q, q.T, strict=True)), dict(zip(spec.v, v.T, strict=True)))


def path(result):
    return [r.idx for r in results.visited(result).orderBy("ord").collect()]


def flips(values):
    return int((np.sign(values[1:]) != np.sign(values[:-1])).sum())


def test_momentum_decides_between_equal_distances(spark):
    df = curve(spark, TWO, [[0, 0], [1, 0], [-1, 0]], [[1, 0], [0, 0], [0, 0]])
    assert path(order(df, TWO, LocalFlowOrderer(10.0)))[1] == 1
    assert path(order(curve(spark, ONE, np.arange(5)[:, None], -np.ones((5, 1))), ONE, LocalFlowOrderer(1.0, start=2)))[1] == 1


def test_walks_in_space(spark):
    diagonal = curve(spark, THREE, [[0, 0, 100], [1, 0.5, 101], [2, 1, 102]], np.ones((3, 3)))
    assert path(order(diagonal, THREE)) == [0, 1, 2]
    t = np.linspace(0, 4 * np.pi, 20)
    helix = curve(spark, THREE, np.stack([np.cos(t), np.sin(t), t / (4 * np.pi)], 1), np.stack([-np.sin(t), np.cos(t), np.full(20, 1 / (4 * np.pi))], 1))
    assert sorted(path(order(helix, THREE))) == list(range(20))


def test_walks_along_arcs_and_noisy_lines(spark):
    t = np.linspace(0, np.pi / 2, 10)
    found = path(order(curve(spark, TWO, np.stack([np.cos(t), np.sin(t)], 1), np.stack([-np.sin(t), np.cos(t)], 1)), TWO, LocalFlowOrderer(2.0)))
    assert len(found) == 10 and np.abs(np.diff(found)).max() <= 3
    r = np.random.default_rng(0)
    x = np.linspace(0, 10, 20) + r.normal(0, 0.1, 20)
    found = path(order(curve(spark, TWO, np.stack([x, r.normal(0, 0.1, 20)], 1), np.tile([1.0, 0.0], (20, 1))), TWO))
    assert np.diff(x[found]).mean() > 0


def test_a_tree_orders_a_line(spark):
    df = curve(spark, TWO, [[i, 0.5 * i] for i in range(5)], np.tile([1.0, 0.5], (5, 1)))
    assert path(MSTOrderer(k=10, jump_cap=3.0).order(df, TWO)) in ([4, 3, 2, 1, 0], [0, 1, 2, 3, 4])
    assert path(MSTOrderer(k=10, jump_cap=3.0, orient_by_velocity=True).order(df, TWO)) == [0, 1, 2, 3, 4]


def test_a_tree_opens_a_ring_at_its_gap(spark):
    gap = np.deg2rad(20)
    angle = np.linspace(gap / 2, 2 * np.pi - gap / 2, 240)[np.random.default_rng(1).permutation(240)]
    df = curve(spark, TWO, np.stack([np.cos(angle), np.sin(angle)], 1), np.stack([-np.sin(angle), np.cos(angle)], 1))
    found = path(MSTOrderer(k=10, jump_cap=0.1).order(df, TWO))
    assert len(found) == 240
    assert abs(np.corrcoef(angle[found], np.arange(240))[0, 1]) > 0.99


def test_clipped_edges_reject_interlopers(spark):
    r = np.random.default_rng(0)
    t = np.linspace(0, 1, 200)
    arc = np.stack([10 * t, np.sin(3 * t)], 1) + r.normal(0, 0.02, (200, 2))
    others = np.stack([r.uniform(0, 10, 15), r.uniform(arc[:, 1].min() - 3, arc[:, 1].max() + 3, 15)], 1)
    df = curve(spark, TWO, np.vstack([arc, others]), np.vstack([np.stack([np.ones(200), 3 * np.cos(3 * t)], 1), r.normal(0, 1, (15, 2))]))
    assert len(path(MSTOrderer(jump_cap=20.0).order(df, TWO))) == 215
    kept = np.array(path(MSTOrderer(jump_cap=20.0, edge_clip_sigma=3.0).order(df, TWO)))
    assert (kept >= 200).sum() <= 6 and (kept < 200).sum() >= 190


def test_velocities_part_the_arms_of_a_hairpin(spark):
    q = np.vstack([np.stack([np.linspace(0, 10, n), np.full(n, y)], 1) for n, y in ((50, 0.0), (40, 0.05))])
    vx = np.repeat([1.0, -1.0], [50, 40])
    df = curve(spark, TWO, q, np.stack([vx, np.zeros(90)], 1))
    by_place, by_both = (path(MSTOrderer(k=6, jump_cap=1.0, velocity_weight=w).order(df, TWO)) for w in (0.0, 5.0))
    assert flips(vx[by_both]) < flips(vx[by_place])
    severed = path(MSTOrderer(k=6, jump_cap=1.0, sever_cos_threshold=0.0, on_disconnected="largest").order(df, TWO))
    assert len(severed) == 50 and (vx[severed] > 0).all()


@pytest.mark.parametrize("width", [0.2])
def test_running_mean_of_a_circle(spark, width):
    a = np.linspace(0, 2 * np.pi, 50)
    df = curve(spark, TWO, np.stack([np.cos(a), np.sin(a)], 1), np.stack([-np.sin(a), np.cos(a)], 1))
    gamma = df.selectExpr("stream_id", "idx", "x", "y", "idx / 49.0D as gamma")
    for r in statistics.running_mean(gamma, gamma, TWO, width).collect():
        near = np.abs(np.arange(50) / 49 - r.gamma) < width / 2
        assert (r.x, r.y) == pytest.approx((np.cos(a)[near].mean(), np.sin(a)[near].mean()))
