"""Models that are replaced while a stream runs, results of training as curves, and SQL over curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwright import nn, sql
from arcwright.functions.mixture import MixtureMembershipConfig
from arcwright.operators import walk
from arcwright.operators.results import Curve
from arcwright.spec import Spec
from arcwright.streaming import ModelStore, score_stream

S = Spec()
SCHEMA = "stream_id string, idx long, x double, y double, vx double, vy double"


def points(spark, n=60, streams=("a", "b")):
    rows = []
    for s in streams:
        t = np.linspace(0, 3, n)
        rows += [(s, i, float(x), float(np.sin(x)), 1.0, float(np.cos(x))) for i, x in enumerate(t)]
    return spark.createDataFrame(rows, SCHEMA)


def config(epochs, mixture=True):
    return nn.TrainingConfig(nn.EncoderConfig(n_epochs=epochs), nn.DecoderConfig(n_epochs=2), n_epochs_both=2, membership=MixtureMembershipConfig() if mixture else None)


SMALL = nn.PathAutoencoder(encoder_size=(8, 1), track_size=(8, 1))


def test_models_are_replaced_while_a_stream_runs(spark, tmp_path):
    df = points(spark)
    order = walk.order(df, S)
    one, two = (nn.train(df, order, S, SMALL, config(n)).cache() for n in (3, 30))
    store = ModelStore(spark, f"file://{tmp_path}/models")
    with pytest.raises(ValueError, match="no models"):
        store.latest()
    assert store.put(one) == 1
    df.where("idx < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = {}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = score_stream(stream, store, S, lambda rows, n: seen.update({n: rows.collect()}), str(tmp_path / "checkpoint"))
    try:
        query.processAllAvailable()
        assert store.put(two.where("stream_id = 'a'")) == 2
        df.where("idx >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        assert store.put(one) == 3
        (tmp_path / "models" / "version-4").mkdir()  # one that isn't complete
        df.where("idx = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    finally:
        query.stop()
    key = lambda rows: sorted((r.stream_id, r.idx, r.gamma, r.prob, r.posterior) for r in rows)
    parts = [seen[n] for n in sorted(seen) if seen[n]]
    assert key(parts[0]) == key(nn.posterior(df.where("idx < 20"), one, S).collect())
    assert key(parts[1]) == key(nn.posterior(df.where("idx >= 20 and stream_id = 'a'"), two, S).collect())
    assert key(parts[2]) == key(nn.posterior(df.where("idx = 0"), one, S).collect()) and len(parts) == 3


def test_a_given_background_on_a_stream(spark, tmp_path):
    df = points(spark, streams=("a",))
    models = nn.train(df, walk.order(df, S), S, SMALL, config(3)).cache()
    store = ModelStore(spark, f"file://{tmp_path}/models")
    store.put(models)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, store, S, lambda rows, n: seen.extend(rows.collect()), str(tmp_path / "c"), background_density=3.0, trigger={"availableNow": True}).awaitTermination(120)
    assert sorted(map(repr, seen)) == sorted(map(repr, nn.posterior(df, models, S, 3.0).collect()))


def test_results_of_training_are_curves(spark):
    df = points(spark)
    order = walk.order(df, S, walk.LocalFlowOrderer(max_dist=0.08, n_max=40))
    made = nn.AutoencoderResult.fit(df, order, S, SMALL, config(300))
    assert isinstance(made, Curve) and made.gamma_range == (-1.0, 1.0)
    prob = {(r.stream_id, r.idx): (r.prob, r.gamma) for r in made.encoded.collect()}
    assert len(prob) == 120 and made.membership.count() == 120
    places = {}
    for r in made.order.collect():
        assert prob[r.stream_id, r.idx][0] >= 0.5
        places.setdefault(r.stream_id, []).append((r.ord, prob[r.stream_id, r.idx][1]))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == list(range(len(own)))
        assert [g for _, g in sorted(own)] == sorted(g for _, g in own)
    assert sum(map(len, places.values())) == sum(p >= 0.5 for p, _ in prob.values()) == made.filled().count()
    gammas = made.models.select("stream_id", F.explode(F.array(F.lit(-1.0), F.lit(0.3), F.lit(1.0))).alias("gamma"))
    rows = lambda t: sorted(map(repr, t.collect()))
    assert rows(made(gammas)) == rows(nn.decode(gammas, made.models, S))
    with pytest.raises(Exception, match="gamma must be in"):
        made(gammas.withColumn("gamma", F.lit(1.01))).collect()
    assert made.posterior().count() == 120


def test_results_with_an_external_decoder_keep_the_order(spark):
    df = points(spark, streams=("a",))
    order = walk.order(df, S, walk.LocalFlowOrderer(n_max=40))
    made = nn.AutoencoderResult.fit(df, order, S, nn.EncoderExternalDecoder(encoder_size=(8, 1)), config(100, mixture=False))
    assert sorted(map(repr, made.order.collect())) == sorted(map(repr, order.collect()))
    gamma = made.encoded.where("prob >= 0.5").select("stream_id", "gamma").limit(5)
    assert made(gamma).count() == gamma.count()


def test_uniform_weights():
    assert nn.compute_uniform_weights(np.array([0.1, 0.7])).tolist() == [1.0, 1.0]


def test_sql_over_curves(spark):
    sql.register(spark, S)
    df = points(spark).withColumn("extra", F.lit(1)).repartition(7)
    df = df.unionByName(df.where("stream_id = 'a'").withColumn("stream_id", F.lit(None).cast("string")))
    df.createOrReplaceTempView("sql_points")
    rows = lambda t: sorted(map(repr, t.select("stream_id", "idx", "ord").collect()))
    got = spark.sql("SELECT * FROM walk_order(TABLE(sql_points) PARTITION BY stream_id)")
    assert rows(got) == rows(walk.order(df, S))
    got = spark.sql("SELECT * FROM walk_order(TABLE(SELECT * FROM sql_points WHERE idx <> 7) PARTITION BY (stream_id), 'full', 0.5D, 0.06D)")
    want = walk.order(df.where("idx <> 7"), S, walk.LocalFlowOrderer(0.5, walk.WalkConfig(sql.METRICS["full"]()), max_dist=0.06))
    assert rows(got) == rows(want) and got.where("ord is null").count() > 0
    joined = spark.sql("SELECT p.stream_id, max(o.ord) AS last FROM sql_points p JOIN (SELECT * FROM walk_order(TABLE(sql_points) PARTITION BY stream_id)) o ON p.stream_id = o.stream_id AND p.idx = o.idx GROUP BY p.stream_id")
    assert {(r.stream_id, r["last"]) for r in joined.collect()} == {("a", 59), ("b", 59)}
    for bad, says in (("TABLE(SELECT 1 AS one) PARTITION BY one", "no columns"), ("TABLE(sql_points) PARTITION BY (stream_id), 'none'", "metric"), ("TABLE(sql_points) PARTITION BY (stream_id), 'full', 1D, -1D", "positive"), ("TABLE(sql_points) WITH SINGLE PARTITION", "partitioned")):
        with pytest.raises(Exception, match=says):
            spark.sql(f"SELECT * FROM walk_order({bad})").collect()
    assert spark.sql("SELECT * FROM walk_order(TABLE(SELECT * FROM sql_points WHERE false) PARTITION BY stream_id)").collect() == []
    one = spark.sql("SELECT phase_distance(array(0D, 0D), array(3D, 4D)) AS d, phase_unit(array(0D, 0D)) AS z, phase_direction(array(1D), array(-1D)) AS w, phase_cosine(array(0D), array(1D)) AS c").first()
    assert (one.d, one.z, one.w, one.c) == (5.0, [0.0, 0.0], [-1.0], 0.0)
