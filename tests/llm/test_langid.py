import zlib

import numpy as np
from pyspark.sql import functions as F

from arcwright.llm import langid
from arcwright.llm.common import read

HELD = "crc32(cast(doc_id as string)) % 4 = 2"


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = langid.languages(docs, HELD).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang_pred == r.lang for r in got) / len(got)
    assert right > 0.95, right
    assert all(0 <= r.score <= 1 for r in got)


def test_tables_equal_the_network():
    r = np.random.default_rng(0)
    net = langid.train(["abc abd " * 40, "xyz xyy " * 40] * 4, ["a", "b"] * 4)
    x = r.integers(0, 256, (5, langid.LENGTH)).astype(np.uint8)
    pooled, _ = langid._forward(net, x)
    z = np.maximum(pooled, 0) @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(langid.Applied(net).log_probabilities(x), want, atol=1e-4)
    one = langid.Applied(net).predict(np.frombuffer(b"abc abd xyz" * 50, np.uint8), np.array([0, 0, 550]))
    assert one[0].shape == (2,) and (one[1] <= 1).all()


def test_odd_cases(spark, odd):
    odd = odd.unionByName(spark.createDataFrame([(None, "text without an id", "fr", None, None, None, None)], odd.schema))
    got = langid.languages(odd, HELD).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score == 0))
    assert by[0] == by[1] == by[2] == {("und", True)} and ("und", True) in by[3] and len(by[3]) == 2
    assert all(x != "und" and not zero for i in (4, 6, 7, 9, 10, 14, None) for x, zero in by[i])
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.languages(none, HELD).collect()} == {"und"}
    assert langid.languages(odd.limit(0), HELD).collect() == []


def test_rows_are_sampled_with_their_own_labels(spark):
    rows = [(1, "first text", "a"), (1, "second text", "b"), (1, "second text", "b"), (2, "third", "a"), (None, "x", "a"), (3, None, "a"), (4, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(tuple, langid.sample(docs, "true").collect())) == [("first text", "a"), ("second text", "b"), ("third", "a")]
    many = spark.range(5000).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id % 100) as lang")
    count = {r.label: r.n for r in langid.sample(many, "true").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert len(count) == 100 and set(count.values()) == {50}
    count = {r.label: r.n for r in langid.sample(many, "true", most=20).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert len(count) == 100 and set(count.values()) == {20}
    assert langid.sample(many, "true", most=20, most_of_all=200).count() <= 250


def test_gradients_against_differences():
    r = np.random.default_rng(5)
    names = ["a", "b", "c"]
    p = langid.start(names, r)
    x, y = r.integers(97, 110, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    _, grads = langid.gradients(langid.network(names, p), x, y)
    for a, g in zip(p, grads, strict=True):
        some = np.argsort(-np.abs(g).ravel())[:6]
        for i in [*some.tolist(), *r.integers(0, a.size, 4).tolist()]:
            old, step = a.flat[i], 1e-6
            a.flat[i] = old + step
            up, _ = langid.gradients(langid.network(names, p), x, y)
            a.flat[i] = old - step
            down, _ = langid.gradients(langid.network(names, p), x, y)
            a.flat[i] = old
            assert abs((up - down) / (2 * step) - g.flat[i]) < 1e-5


def test_windows_are_bounded(spark):
    """Very long sampled texts: as many windows as stated, of all places, still tell the languages apart."""
    docs = spark.createDataFrame([(i, ("abc abd " if i % 2 else "xyz xyy ") * 4000, "ab"[i % 2]) for i in range(12)], "doc_id long, text string, lang string")
    seen = []
    plain = langid.train_windows
    langid.train_windows = lambda x, y: seen.append((x, y)) or plain(x, y)
    try:
        net = langid.fit(docs, most=500)
    finally:
        langid.train_windows = plain
    assert seen[0][0].shape == (500, langid.LENGTH) and set(seen[0][1]) == {"a", "b"}
    best, _ = langid.Applied(net).predict(np.frombuffer(b"xyz xyy " * 20 + b"abc abd " * 20, np.uint8), np.array([0, 160, 320]))
    assert [net.languages[k] for k in best] == ["a", "b"]
