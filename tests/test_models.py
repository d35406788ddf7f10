"""Schedules, gradients, outliers and streams of the models."""

import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwright import nn, sources
from arcwright.functions.mixture import MixtureMembershipConfig
from arcwright.nn import training
from arcwright.nn.networks import FourierTrackNet, OrderingNet, TrackNet
from arcwright.plans import queries
from arcwright.spec import Spec
from arcwright.streaming import encode_stream

S = Spec()


def test_queries_train_by_the_defaults(spark, sf):
    models = queries._models(spark, sf).collect()
    assert len(models) == 10
    epochs = nn.EncoderConfig().n_epochs + nn.DecoderConfig().n_epochs + nn.TrainingConfig().n_epochs_both
    assert epochs == 800 + 100 + 200
    for m in models:
        assert len(m.losses) == epochs
        made = pickle.loads(m.model)
        assert [w.shape for w in made["encoder"].body.w] == [(6, 100), (100, 100), (100, 100)]
        assert [w.shape for w in made["track"].mlp.w] == [(1, 128), (128, 128), (128, 128), (128, 3)]
        assert made["width"] is not None


def gradients(loss, parameters, grads, rng, places=3):
    """Numerical slopes of the loss at a few places of each parameter against the gradients."""
    for p, g in zip(parameters, grads, strict=True):
        for _ in range(places):
            at = tuple(int(rng.integers(0, n)) for n in p.shape)
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("kind", [TrackNet, FourierTrackNet])
def test_gradients_and_tangents_of_tracks(kind):
    rng = np.random.default_rng(1)
    net = kind(2, rng, width=8, depth=2)
    gamma, q = rng.uniform(-1, 1, 7), rng.normal(0, 1, (7, 2))
    x, kept = net.forward(gamma)
    by_gamma, grads = net.backward(kept, 2 * (x - q))
    loss = lambda: float(((net(gamma) - q) ** 2).sum())
    gradients(loss, net.parameters, grads, rng)
    gradients(loss, [gamma], [by_gamma], rng, 7)
    h = 1e-6
    assert np.allclose(net.tangent(gamma), (net(gamma + h) - net(gamma - h)) / (2 * h), atol=1e-5)


def test_gradients_of_the_encoder():
    rng = np.random.default_rng(2)
    net = OrderingNet(4, rng, 8, 2, (0.0, 2.0))
    ws, gamma, want = rng.normal(0, 1, (9, 4)), rng.uniform(0, 2, 9), rng.uniform(0, 1, 9)

    def loss():
        g, p = net(ws)
        return float(((g - gamma) ** 2).sum() + 3 * ((p - want) ** 2).sum())

    g, p, kept = net.forward(ws)
    assert ((g > 0) & (g < 2) & (p > 0) & (p < 1)).all()
    gradients(loss, net.parameters, net.backward(kept, 2 * (g - gamma), 6 * (p - want)), rng)


def test_gradients_of_the_path_step():
    """Directions are compared without a gradient, so the slopes are those without their term."""
    rng = np.random.default_rng(3)
    encoder, track = OrderingNet(4, rng, 8, 1), TrackNet(2, rng, width=8, depth=2)
    ws, mask, weights = rng.normal(0, 1, (12, 4)), rng.random(12) < 0.7, rng.uniform(0.5, 2, 12)
    threshold = float(np.median(encoder(ws)[1]))
    step = lambda: training.path_step(encoder, track, ws, mask, weights, threshold, 1.0, 0.0)
    loss, by_encoder, by_track = step()
    member = encoder(ws)[1] > threshold
    assert (mask & member).any() and (mask & ~member).any() and (~mask & member).any()
    gradients(lambda: step()[0], encoder.parameters, by_encoder, rng)
    gradients(lambda: step()[0], track.parameters, by_track, rng)
    with_directions = training.path_step(encoder, track, ws, mask, weights, threshold, 1.0, 2.0)[0]
    assert math.isfinite(with_directions) and with_directions != loss


@pytest.mark.parametrize(("offset", "low", "high"), [(3, 0, 3), (10, 28, 30), (20, 28, 30)])
def test_outliers_of_an_arc(offset, low, high):
    """400 members of width 0.15 and 30 outliers beside the arc, cut at a posterior of 0.5 after a warm-up of 0.3."""
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 1.9, 400))
    across, along = np.stack([np.cos(t), np.sin(t)], 1), np.stack([-np.sin(t), np.cos(t)], 1)
    pick = rng.choice(400, 30, replace=False)
    q = np.vstack([10 * across + 0.15 * rng.normal(size=(400, 1)) * across, 10 * across[pick] + offset * 0.15 * rng.choice([-1, 1], (30, 1)) * across[pick]])
    ws = np.hstack([q, np.vstack([along, along[pick]])])
    mean, std = ws.mean(axis=0), ws.std(axis=0)
    ws = (ws - mean) / std
    config = nn.TrainingConfig(nn.EncoderConfig(n_epochs=200), membership=MixtureMembershipConfig(warmup_frac=0.3))
    encoder, track, width, rng = nn.PathAutoencoder(encoder_size=(32, 2), track_size=(32, 2)).make(2, config.membership)
    training.train_all(encoder, track, width, ws, np.argsort(np.concatenate([t, t[pick]])), config, rng)
    gamma, p = encoder(ws)
    r2, sigma = ((ws[:, :2] - track(gamma)) ** 2).sum(axis=1), width(gamma)
    here = p * np.exp(-0.5 * r2 / sigma**2) / (2 * np.pi * sigma**2)
    posterior = here / (here + (1 - p) * training.background_density(ws[:, :2]))
    assert low <= (posterior[400:] < 0.5).sum() <= high
    assert (posterior[:400] < 0.5).sum() <= 4


@pytest.fixture(scope="module")
def arc(spark):
    t = np.linspace(0, 1, 40)
    rows = [(s, i, float(10 * a), float(2 * np.sin(3 * a)), 10.0, float(6 * np.cos(3 * a))) for s in ("a", None) for i, a in enumerate(t)]
    df = spark.createDataFrame(rows, "stream_id string, idx long, x double, y double, vx double, vy double")
    result = df.select("stream_id", "idx", F.col("idx").alias("ord"))
    config = nn.TrainingConfig(nn.EncoderConfig(n_epochs=20), nn.DecoderConfig(n_epochs=5), n_epochs_both=5)
    return df, nn.train(df, result, S, nn.PathAutoencoder(encoder_size=(8, 1), track_size=(8, 1)), config).cache()


def test_a_stream_of_points_is_encoded_as_a_table_is(spark, arc, tmp_path):
    df, models = arc
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    points = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = encode_stream(points, models, S).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.stream_id, r.idx): r.gamma for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx({(r.stream_id, r.idx): r.gamma for r in nn.encode(df, models, S).collect()})
    assert len(got) == 80


def test_tables_of_points_are_written_by_curve(spark, arc, tmp_path):
    df = arc[0].where("stream_id is not null")
    sources.write(df, str(tmp_path / "points"), S)
    assert [p.name for p in (tmp_path / "points").glob("stream_id=*")] == ["stream_id=a"]
    assert sorted(spark.read.parquet(str(tmp_path / "points")).select(df.columns).collect()) == sorted(df.collect())
