import math

import numpy as np
import pytest

from arcwright import nn
from arcwright.functions import metrics as M
from arcwright.functions import mixture, units
from arcwright.operators import results, statistics
from arcwright.operators.mst import MSTOrderer
from arcwright.operators.walk import LocalFlowOrderer, Nearest, WalkConfig, combined, order, walk_local_flow
from arcwright.sources import from_arrays
from arcwright.spec import Spec

ONE, TWO = Spec(("x",), ("vx",)), Spec()


def line(spark, xs, vs=None):
    return from_arrays(spark, ONE, {"x": xs}, {"vx": [1.0] * len(xs) if vs is None else vs})


def path(result):
    return [r.idx for r in result.where("ord is not null").orderBy("ord").collect()]


def skips(result):
    return sorted(r.idx for r in results.skipped(result).collect())


@pytest.mark.parametrize(
    ("xs", "options", "want", "skipped"),
    [
        (range(5), {}, [0, 1, 2, 3, 4], []),
        ([0, 1, 10], {"metric_scale": 0.0, "max_dist": 5}, [0, 1], [2]),
        (range(5), {"metric_scale": 0.0, "n_max": 3}, [0, 1, 2], [3, 4]),
        (range(5), {"metric_scale": 0.0, "terminate": frozenset({2})}, [0, 1, 2], [3, 4]),
        ([0, 1, 2, 10, 11], {"start": 1, "direction": "both", "max_dist": 2}, None, [3, 4]),
        ([3], {}, [0], []),
    ],
)
def test_lines(spark, xs, options, want, skipped):
    got = order(line(spark, list(xs)), ONE, LocalFlowOrderer(**options))
    assert want is None or path(got) == want
    assert skips(got) == skipped


def test_directions_and_strategies(spark):
    df = line(spark, list(range(5)))
    assert path(order(df, ONE, LocalFlowOrderer(start=4, direction="backward")))[1] == 3
    assert sorted(path(order(df, ONE, LocalFlowOrderer(start=2, direction="both")))) == [0, 1, 2, 3, 4]
    assert combined([2, 3, 4], [2, 1, 0, 3]) == [3, 0, 1, 2, 4]
    near = LocalFlowOrderer(0.5, WalkConfig(strategy=Nearest(2)))
    t = from_arrays(spark, TWO, {"x": [0, 1, 2, 3], "y": [0, 0.5, 0.8, 1.2]}, {"vx": [1] * 4, "vy": [0.2] * 4})
    assert path(order(t, TWO, near)) == [0, 1, 2, 3]
    with pytest.warns(DeprecationWarning):
        assert path(walk_local_flow(t, TWO)) == [0, 1, 2, 3]


def test_errors(spark):
    with pytest.raises(ValueError):
        LocalFlowOrderer(max_dist=0)
    with pytest.raises(Exception, match="out of bounds"):
        order(line(spark, [0, 1, 2]), ONE, LocalFlowOrderer(start=10)).collect()
    with pytest.raises(Exception, match="finite"):
        order(line(spark, [0, float("nan")]), ONE).collect()
    assert order(line(spark, [0, 1]).limit(0), ONE).collect() == []


def test_interpolation(spark):
    t = from_arrays(spark, TWO, {"x": [0, 1, 2, 3], "y": [0, 0.5, 1, 1.5]}, {"vx": [1] * 4, "vy": [0.5] * 4})
    r = order(t, TWO)
    ask = lambda *g: spark.createDataFrame([("0", x) for x in g], "stream_id string, gamma double")
    got = sorted((x.gamma, x.x, x.y) for x in results.interpolate(t, r, ask(0.0, 0.5, 1.0), TWO).collect())
    assert got == [(0, 0, 0), (0.5, 1.5, 0.75), (1, 3, 1.5)]
    with pytest.raises(Exception, match="gamma must be in"):
        results.interpolate(t, r, ask(1.5), TWO).collect()


def test_spanning_tree(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 1, 200))
    mix = rng.permutation(200)
    pos = {"x": (10 * t + rng.normal(0, 0.02, 200))[mix], "y": (np.sin(3 * t) + rng.normal(0, 0.02, 200))[mix]}
    df = from_arrays(spark, TWO, pos, {"vx": np.full(200, 10.0), "vy": (3 * np.cos(3 * t))[mix]})
    rank = {r.idx: r.ord for r in MSTOrderer(orient_by_velocity=True).order(df, TWO).collect()}
    assert np.corrcoef([rank[i] for i in range(200)], t[mix])[0, 1] > 0.99
    apart = from_arrays(spark, TWO, {"x": [0, 1, 2, 100, 101], "y": [0] * 5}, {"vx": [1] * 5, "vy": [0] * 5})
    with pytest.raises(Exception, match="components"):
        MSTOrderer(k=2).order(apart, TWO).collect()
    assert skips(MSTOrderer(k=2, on_disconnected="largest").order(apart, TWO)) == [3, 4]
    same = from_arrays(spark, TWO, {"x": [0, 0, 0, 1], "y": [0] * 4}, {"vx": [1] * 4, "vy": [0] * 4})
    assert len(path(MSTOrderer().order(same, TWO))) == 4


def test_schedules_and_statistics(spark):
    assert mixture.sigma_ceiling(1, 2, 1.0, 0.01) == pytest.approx(0.01)
    assert mixture.membership_rampup(2, 10, 0.5) == pytest.approx(4 / 9)
    df = line(spark, [1.0, 3.0], [1.0, 1.0])
    s = statistics.StandardScaler.fit(df, ONE).stats.first()
    assert s.std_x == pytest.approx(1.0) and s.std_vx == pytest.approx(1e-8)
    assert statistics.uniform_background_density(df, ONE).first().density == 0.5
    means = statistics.window_means(np.array([0.0, 0.5]), np.array([0.0, 0.05, 0.1]), np.array([[1.0], [3.0], [9.0]]), 0.1)
    assert means[0] == pytest.approx([1.0]) or means[0] == pytest.approx([1.0], abs=1e-6)
    assert means[1] == [0.0]


def test_units(spark):
    df = from_arrays(spark, TWO, {"x": [0, 1, 2], "y": [0, 0.5, 1]}, {"vx": [1] * 3, "vy": [0.2] * 3})
    df = units.with_unit(df, x="km", y="km", vx="km/s", vy="km/s")
    si = units.UnitSystem("m", "s")
    got = order(df, TWO, LocalFlowOrderer(units.Quantity(1, "km"), max_dist=units.Quantity(2, "km")), units=si)
    assert path(got) == [0, 1, 2]
    with pytest.raises(TypeError):
        order(df, TWO, LocalFlowOrderer())
    with pytest.raises(TypeError):
        order(df, TWO, LocalFlowOrderer(1.0, max_dist=5.0), units=si)
    assert units.stripped(df, TWO, si).collect()[1].x == 1000
    assert units.unit_of(units.reattached(units.stripped(df, TWO, si), TWO, si), "vx") == "m/s"


def test_gradients():
    from arcwright.nn.networks import OrderingNet, TrackNet, WidthNet
    from arcwright.nn.training import mixture_step

    rng = np.random.default_rng(0)
    enc, track, width = OrderingNet(4, rng, 8, 1), TrackNet(2, rng, 8, 2), WidthNet(rng, 8, 1, 0.3)
    for p in width.parameters:
        p += rng.normal(0, 0.1, p.shape)
    ws, mask = rng.normal(0, 1, (9, 4)), np.ones(9, bool)

    def loss():
        return mixture_step(enc, track, width, ws, mask, -2.0, 10.0, 0.7, 0.0, 1.0)

    r0 = loss()
    for net, grads in zip((enc, track, width), r0[1:], strict=True):
        for p, g in zip(net.parameters, grads, strict=True):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old = p[at]
            p[at] = old + 1e-6
            up = loss()[0]
            p[at] = old - 1e-6
            down = loss()[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)
    h = 1e-6
    g = np.array([0.1, -0.4])
    assert np.allclose(track.tangent(g), (track(g + h) - track(g - h)) / (2 * h), atol=1e-5)


def test_training_orders_an_arc(spark):
    t = np.linspace(0, 1, 80)
    df = from_arrays(spark, TWO, {"x": 10 * t, "y": 2 * np.sin(3 * t)}, {"vx": np.full(80, 10.0), "vy": 6 * np.cos(3 * t)})
    r = order(df, TWO, LocalFlowOrderer(max_dist=3.0))
    config = nn.TrainingConfig(nn.EncoderConfig(n_epochs=300), nn.DecoderConfig(n_epochs=60), n_epochs_both=60, membership=mixture.MixtureMembershipConfig())
    m = nn.train(df, r, TWO, nn.PathAutoencoder(encoder_size=(32, 2), track_size=(32, 2)), config).cache()
    e = {x.idx: x for x in nn.encode(df, m, TWO).collect()}
    assert abs(np.corrcoef([e[i].gamma for i in range(80)], t)[0, 1]) > 0.9
    assert all(0 <= x.posterior <= 1 for x in nn.posterior(df, m, TWO).collect())
    assert nn.fill_gaps(nn.encode(df, m, TWO), TWO).count() > 40
    from arcwright.streaming import encode_stream

    assert {x.idx: x.gamma for x in encode_stream(df, m, TWO).collect()} == pytest.approx({i: x.gamma for i, x in e.items()})
    external = nn.train(df, r, TWO, nn.EncoderExternalDecoder(), nn.TrainingConfig(nn.EncoderConfig(n_epochs=50)))
    with pytest.raises(Exception, match="mixture"):
        nn.posterior(df, external, TWO).collect()
    assert math.isfinite(external.first().losses[-1])


def test_custom_metric(spark):
    class Taxi(M.Metric):
        def column(self, q0, v0, q, v, scale):
            raise NotImplementedError

        def array(self, q0, v0, q, v, scale):
            return np.abs(q - q0).sum(axis=1)

    df = from_arrays(spark, TWO, {"x": [0, 3, 2.2], "y": [0, 0, 2.2]}, {"vx": [1] * 3, "vy": [0] * 3})
    assert path(order(df, TWO, LocalFlowOrderer(config=WalkConfig(Taxi())))) == [0, 1, 2]
