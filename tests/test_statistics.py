"""Weights, running means and the scaler over awkward curves and with units, against brute force."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arcwright.functions import units as U
from arcwright.operators import statistics
from arcwright.spec import Spec

S = Spec()


def gammas(spark, streams):
    rows = [(s, i, None if g is None else float(g), float(i % 7), float(i % 3)) for s, own in streams.items() for i, g in enumerate(own)]
    return spark.createDataFrame(rows, "stream_id string, idx long, gamma double, x double, y double")


@pytest.fixture(scope="module")
def curves():
    r = np.random.default_rng(4)
    return {
        "spread": r.uniform(-1, 1, 300),
        "clustered": np.concatenate([r.normal(0.3, 1e-4, 200), [5.0], np.full(100, -0.25)]),
        "edges": np.arange(-20, 21) * 0.01,
        "one": np.array([0.7]),
        None: r.uniform(0, 1, 40),
    }


@pytest.mark.parametrize("bandwidth", [0.02, 0.5, 1e-3])
def test_inverse_density_weights(spark, curves, bandwidth):
    got = {(r.stream_id, r.idx): r.weight for r in statistics.inverse_density_weights(gammas(spark, curves), S, bandwidth).collect()}
    assert len(got) == sum(len(g) for g in curves.values())
    for s, g in curves.items():
        want = 1.0 / np.exp(-0.5 * ((g[:, None] - g[None, :]) / bandwidth) ** 2).mean(axis=1)
        assert np.allclose([got[s, i] for i in range(len(g))], want, rtol=1e-10, atol=0)


def test_gammas_that_are_no_numbers_have_no_weight(spark):
    df = gammas(spark, {"s": [0.1, None, float("nan"), float("inf"), 0.1]})
    assert [(r.idx, round(r.weight, 12)) for r in statistics.inverse_density_weights(df, S).orderBy("idx").collect()] == [(0, 1.0), (4, 1.0)]
    assert statistics.inverse_density_weights(df.where("false"), S).count() == 0


@pytest.mark.parametrize("width", [0.05, 0.02, 3.0])
def test_running_mean(spark, curves, width):
    df = gammas(spark, curves)
    got = {(r.stream_id, r.idx): (r.x, r.y) for r in statistics.running_mean(df, df, S, width).collect()}
    assert len(got) == df.count()
    for s, g in curves.items():
        q = np.array([[i % 7, i % 3] for i in range(len(g))], float)
        inside = np.abs(g[:, None] - g[None, :]) < width / 2
        want = (inside @ q) / (inside.sum(axis=1)[:, None] + 1e-10)
        assert np.allclose([got[s, i] for i in range(len(g))], want, rtol=1e-9, atol=1e-9)


def test_running_mean_outside_the_members_is_an_error(spark):
    known = gammas(spark, {"s": [0.0, 1.0]})
    for at in (1.5, -0.1):
        with pytest.raises(PySparkException, match="outside the range"):
            statistics.running_mean(known, gammas(spark, {"s": [at]}), S).collect()
    with pytest.raises(PySparkException, match="outside the range"):
        statistics.running_mean(known, gammas(spark, {"other": [0.5]}), S).collect()
    assert statistics.running_mean(known, known.where("false"), S).count() == 0


@pytest.fixture(scope="module")
def measured(spark):
    rows = [("s", i, float(i), 2.0 * i, 3.0 - i, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "stream_id string, idx long, x double, y double, vx double, vy double")
    return U.with_unit(df, x="kpc", y="kpc", vx="km/s", vy="km/s")


def test_scalars_with_units(spark, measured):
    df = U.with_unit(measured.withColumn("px", F.lit(0.0)).withColumn("py", F.lit(1000.0)), px="pc", py="pc")
    out = U.with_velocity_norm(U.with_distance(df, "d", ["x", "y"], ["px", "py"]), "speed", ["vx", "vy"])
    out = U.with_unit_direction(out, ["dx", "dy"], ["px", "py"], ["x", "y"])
    out = U.with_cosine(U.with_unit_velocity(out, ["ux", "uy"], ["vx", "vy"]), "c", ["x", "y"], ["vx", "vy"])
    assert (U.unit_of(out, "d"), U.unit_of(out, "speed"), U.unit_of(out, "dx"), U.unit_of(out, "ux"), U.unit_of(out, "c")) == ("kpc", "km/s", "", "", "")
    for r in out.collect():
        assert np.isclose(r.d, np.hypot(r.x, r.y - 1))
        assert np.isclose(r.speed, np.hypot(r.vx, r.vy))
        assert np.allclose([r.dx * r.d, r.dy * r.d], [r.x, r.y - 1])
        assert np.allclose([r.ux * r.speed, r.uy * r.speed], [r.vx, r.vy])
        assert np.isclose(r.c, (r.x * r.vx + r.y * r.vy) / (np.hypot(r.x, r.y) * r.speed) if r.x else 0.0)
    with pytest.raises(TypeError):
        U.with_velocity_norm(measured.withMetadata("vx", {}), "n", ["vx", "vy"])
    with pytest.raises(ValueError):
        U.with_distance(measured, "n", ["x", "y"], ["vx", "vy"])
    with pytest.raises(ValueError):
        U.with_velocity_norm(measured, "n", ["x", "y"])


def test_scaler_with_units(spark, measured):
    scaler = statistics.StandardScaler.fit(measured, S)
    plain = scaler.transform(measured)
    assert U.unit_of(plain, "x") == ""
    in_pc = U.with_unit(measured.withColumn("x", F.col("x") * 1000), x="pc")
    a, b = ([r.x for r in scaler.transform(t).orderBy("idx").collect()] for t in (measured, in_pc))
    assert np.allclose(a, b) and np.isclose(np.std(a), 1.0)
    back = scaler.inverse_transform(plain)
    assert (U.unit_of(back, "x"), U.unit_of(back, "vx")) == ("kpc", "km/s")
    assert np.allclose([r.x for r in back.orderBy("idx").collect()], range(5))
    with pytest.raises(TypeError):
        scaler.transform(measured.withMetadata("x", {}))
    with pytest.raises(TypeError):
        scaler.inverse_transform(measured)
    with pytest.raises(ValueError):
        scaler.transform(U.with_unit(measured, x="km/s"))
