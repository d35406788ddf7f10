"""Training that is handed from task to task."""

import pickle

import numpy as np
import pytest

from arcwright import nn
from arcwright.functions.mixture import MixtureMembershipConfig
from arcwright.nn import model, networks, training
from arcwright.spec import Spec

S = Spec()
SHORT = {"encoder": nn.EncoderConfig(n_epochs=7, batch_size=20), "decoder": nn.DecoderConfig(n_epochs=5, batch_size=20), "n_epochs_both": 6, "batch_size": 20}
NET = nn.PathAutoencoder(encoder_size=(8, 1), track_size=(8, 1))


@pytest.fixture(scope="module")
def arcs(spark):
    rows = []
    for s, n in (("a", 150), (None, 110), ("small", 12)):
        t = np.random.default_rng(n).uniform(0, 1.9, n)
        place = np.argsort(np.argsort(t)).tolist()
        rows += [(s, i, float(10 * np.cos(x)), float(10 * np.sin(x)), float(-np.sin(x)), float(np.cos(x)), place[i] if i % 9 else None) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "stream_id string, idx long, x double, y double, vx double, vy double, ord long")
    return df.drop("ord").cache(), df.select("stream_id", "idx", "ord").cache()


def table(models) -> dict:
    out = {}
    for r in models.collect():
        m = pickle.loads(r.model)
        nets = [m["encoder"], *([m["track"], m["width"]] if not isinstance(m["track"], nn.RunningMeanDecoder) else [])]
        out[r.stream_id] = r.losses, [p.tolist() for net in nets if net for p in net.parameters], m["mean"].tolist(), m["std"].tolist(), m["background"]
    return out


@pytest.mark.parametrize(
    ("net", "options"),
    [
        (NET, {"membership": MixtureMembershipConfig(), "member_threshold": 0.0}),
        (NET, {"weight_by_density": True, "member_threshold": 0.4}),
        (NET, {"freeze_encoder": True, "member_threshold": 0.4}),
        (NET, {"member_threshold": 1.0}),
        (nn.EncoderExternalDecoder(nn.RunningMeanDecoder(0.5), encoder_size=(8, 1)), {}),
    ],
)
def test_a_curve_that_is_handed_on_gets_the_same_model(arcs, net, options):
    config = nn.TrainingConfig(**SHORT, **options)
    whole = table(nn.train(*arcs, S, net, config))
    handed = nn.train(*arcs, S, net, config, at_once=400)
    assert set(whole) == {"a", None, "small"}
    assert table(handed) == whole


def test_a_task_passes_over_a_bounded_number_of_points(arcs, monkeypatch):
    df, order = (x.where("stream_id = 'a'").toPandas() for x in arcs)
    ws, path = df[list((*S.q, *S.v))].to_numpy(), order.dropna().sort_values("ord").index.to_numpy()
    for most in (151, 400, 1000):
        *nets, rng = NET.make(2, MixtureMembershipConfig())
        course, passed = training.Course(*nets, ws, path, nn.TrainingConfig(**SHORT, membership=MixtureMembershipConfig(), member_threshold=0.0), rng), []
        real = training.batches
        monkeypatch.setattr(training, "batches", lambda n, size, rng: passed.append(n) or real(n, size, rng))
        tasks = 0
        while not course.finished:
            course, before = pickle.loads(pickle.dumps(course)), len(passed)
            course.advance(most)
            assert 0 < sum(passed[before:]) <= most
            tasks += 1
        monkeypatch.setattr(training, "batches", real)
        assert len(passed) == 18 and tasks >= sum(passed) // most


def test_defaults_bound_a_task_by_points_and_epochs(arcs, monkeypatch):
    """A curve of 2,000 points passes over 2.2 million points in 1,100 epochs: more than one task's share."""
    asked = []
    monkeypatch.setattr(model, "by_size", lambda df, stream, most: asked.append(most) or (df, None))
    nn.train(*arcs, S)
    assert asked == [model.AT_ONCE // 1100] and asked[0] < 2000


@pytest.mark.parametrize("options", [{"membership": MixtureMembershipConfig()}, {"member_threshold": 0.4, "weight_by_density": True}])
@pytest.mark.parametrize("n_freq", [0, 2])
def test_all_steps_are_in_single_precision(arcs, monkeypatch, options, n_freq):
    """Nothing in a step turns gradients into doubles, in which products take twice and tanh five times as long."""
    df, order = (x.where("stream_id = 'a'").toPandas() for x in arcs)
    ws, path = df[list((*S.q, *S.v))].to_numpy(), order.dropna().sort_values("ord").index.to_numpy()
    kinds, real = set(), training.AdamW.step
    monkeypatch.setattr(training.AdamW, "step", lambda self, grads: kinds.update(x.dtype.name for x in (*grads, *self.p, *self.m, *self.s)) or real(self, grads))
    *nets, rng = nn.PathAutoencoder(encoder_size=(8, 1), track_size=(8, 1), n_freq=n_freq).make(2, options.get("membership"))
    training.train_all(*nets, ws, path, nn.TrainingConfig(**SHORT, **options), rng)
    assert kinds == {"float32"}
    assert {p.dtype.name for net in nets if net for p in net.parameters} == {"float64"}


@pytest.mark.parametrize("options", [{"membership": MixtureMembershipConfig()}, {"member_threshold": 0.4}])
def test_precisions_agree(arcs, options):
    one, two = ({r.stream_id: r for r in nn.train(*arcs, S, NET, nn.TrainingConfig(**SHORT, **options, precision=p)).collect()} for p in ("float32", "float64"))
    df = arcs[0].where("stream_id = 'a'").toPandas()[list((*S.q, *S.v))].to_numpy()
    for stream in one:
        assert one[stream].losses == pytest.approx(two[stream].losses, rel=1e-3)
        a, b = pickle.loads(one[stream].model), pickle.loads(two[stream].model)
        (g, p), (h, q) = (m["encoder"]((df - m["mean"]) / m["std"]) for m in (a, b))
        assert np.allclose(g, h, atol=1e-4) and np.allclose(p, q, atol=1e-4) and np.allclose(a["track"](h), b["track"](h), atol=1e-3)
    with pytest.raises(ValueError, match="precision"):
        nn.TrainingConfig(precision="float16")


def test_tanh_of_single_precision():
    z = np.concatenate([np.linspace(-12, 12, 5001), [0, -0.0, 60, -60, 1e4, -1e4, np.inf, -np.inf, 1e-20]])
    with np.errstate(over="ignore"):
        got = networks._tanh(z.astype(np.float32))
    assert got.dtype == np.float32 and np.abs(got - np.tanh(z)).max() < 3e-7 and (np.abs(got) <= 1).all()
    assert np.array_equal(networks._tanh(z.copy()), np.tanh(z))


def test_sums_of_gradients_do_not_become_subnormal():
    p = [np.ones((80, 80), np.float32), np.ones(3, np.float32)]
    adam = networks.AdamW(p)
    adam.step([np.full_like(x, 1e-3) for x in p])
    for _ in range(2000):
        adam.step([np.zeros_like(x) for x in p])
    assert all(((x == 0) | (np.abs(x) >= np.finfo(np.float32).tiny)).all() for x in (*adam.m, *adam.s))
    assert all((adam.m[i] == 0).all() and (adam.s[i] > 0).all() for i in range(2))
