"""Steps by a tree of the points that are left, against looking at all of them."""

import time

import numpy as np
import pytest

from arcwright.functions import metrics as M
from arcwright.operators import walk


class Plain(M.Metric):
    """A metric without a bound: each step looks at all points that are left."""

    def __init__(self, of):
        self.of = of

    def column(self, *x):
        return self.of.column(*x)

    def array(self, *x):
        return self.of.array(*x)


@pytest.mark.parametrize("metric", [M.Spatial(), M.AlignedMomentum(), M.FullPhaseSpace()], ids=lambda m: type(m).__name__)
@pytest.mark.parametrize("scale", [0.0, 0.3, 5.0, -0.2])
def test_paths_are_those_of_a_full_search(metric, scale):
    for seed, dims in ((1, 1), (2, 2), (3, 3)):
        r = np.random.default_rng(seed)
        q = np.concatenate([r.normal(0, 1, (150, dims)), r.integers(0, 3, (80, dims)), np.zeros((20, dims))]).astype(float)
        v = np.concatenate([r.normal(0, 1, (200, dims)), np.zeros((50, dims))])
        for far in (np.inf, 0.4):
            run = lambda m: walk.steps(q, v, 3, walk.WalkConfig(m), scale, far, set(), len(q))  # noqa: B023, E731
            assert run(metric) == run(Plain(metric))


@pytest.mark.parametrize("metric", [M.Spatial(), M.AlignedMomentum(), M.FullPhaseSpace()], ids=lambda m: type(m).__name__)
def test_bounds_hold(metric):
    r = np.random.default_rng(9)
    for _ in range(300):
        n = int(r.integers(1, 6))
        q, v = r.normal(0, 1, (n, 2)) * r.choice([1e-3, 1.0, 50.0]), r.normal(0, 1, (n, 2))
        q0, v0, scale = r.normal(0, 1, 2), r.normal(0, 1, 2) * r.choice([0.0, 1.0]), float(r.choice([0.0, 0.5, 20.0, -1.0]))
        corners = [tuple(f(x, axis=0).tolist()) for x in (q, v) for f in (np.min, np.max)]
        assert metric.bound(q0, v0, scale)(*corners) <= metric.array(q0, v0, q, v, scale).min()


def test_a_long_curve_within_a_minute():
    n = 100_000
    r = np.random.default_rng(0)
    t = np.sort(r.random(n)) * 50
    q = np.stack([t, np.sin(t)], axis=1) + r.normal(0, 1e-3, (n, 2))
    v = np.stack([np.ones(n), np.cos(t)], axis=1)
    begin = time.process_time()
    path = walk.steps(q, v, 0, walk.WalkConfig(), 1.0, np.inf, set(), n)
    took = time.process_time() - begin
    assert sorted(path) == list(range(n))
    assert took < 60  # a full search takes 10^10 distances
