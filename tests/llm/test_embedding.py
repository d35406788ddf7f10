import numpy as np
import pytest

from arcwright.llm import components, embedding
from arcwright.llm.common import read


def brute(rows, cosine=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    parent = {i: i for i, _ in rows}
    n = dict.fromkeys(parent, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for dim in {len(v) for _, v in good}:
        own = [(i, v / np.linalg.norm(v)) for i, v in good if len(v) == dim]
        x = np.array([v for _, v in own])
        for k, (i, _) in enumerate(own):
            for j in np.flatnonzero(x @ x[k] >= cosine):
                if j != k:
                    n[i] += 1
                    a, b = root(i), root(own[j][0])
                    parent[max(a, b)] = min(a, b)
    return sorted(((i, n[i], root(i), i == root(i)) if i is not None else (None, 0, None, True) for i, _ in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(12, dim))
    rows = [(centre[r.integers(12)] + r.normal(size=dim) * r.choice([0.05, 0.2, 1.0])) * r.choice([0.5, 2.0]) for _ in range(n)]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize(("dim", "cell", "block"), [(3, 32, 16), (8, 64, 1024), (32, 50, 40)])
def test_against_brute_force(spark, dim, cell, block):
    rows = clustered(500, dim, dim)
    rows += [(1000 + i, rows[7][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert result(embedding.links(df, cell=cell, block=block)) == brute(rows)


def test_embeddings_table(spark):
    df = read(spark, "/root/testdata/sf0.1", "embeddings")
    assert result(embedding.links(df, cell=256, block=128)) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_cases(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (None, [1.0, 0.0]), (12, [1e-300, 0.0]), (13, [1e300, 1.0])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, unit string")
    got = {r.vec_id: tuple(r)[1:] for r in embedding.links(df).collect()}
    assert got[7] == (4, 7, True) and got[8] == (4, 7, False) and got[12] == (4, 7, False) and got[13] == (4, 7, False)
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11)) and got[None] == (0, None, True)
    assert embedding.links(df.limit(0)).collect() == []
    assert embedding.links(df.where("vec_id < 4")).count() == 3


def test_components_in_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(components.connected, "__defaults__", (0,))
    rows = clustered(300, 4, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert result(embedding.links(df, cell=64, block=32)) == brute(rows)


def test_one_vector_many_times(spark):
    """Its rows stay where they are: none of them is dealt by the vector."""
    n = 100_000
    df = spark.range(n).selectExpr("id as vec_id", "array(1.0D, 2.0D, 3.0D) as embedding").unionByName(spark.createDataFrame([(n, [1.0, 2.0, 3.01]), (n + 1, [-1.0, 0.0, 0.0])], "vec_id long, embedding array<double>"))
    got = embedding.links(df)
    assert got.where(f"n_links = {n} and component_id = 0 and kept = (vec_id = 0)").count() == n + 1
    assert [tuple(r) for r in got.where("n_links = 0").collect()] == [(n + 1, 0, n + 1, True)]


def test_each_vector_is_dealt_and_packed_once(spark, monkeypatch):
    """Vectors without structure may lie near any cell: blocks meet by reading, and no copies of vectors are shuffled."""
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 24))
    x[300:] = x[:300] + r.normal(size=(300, 24)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    made, real = {}, embedding.C.stored
    monkeypatch.setattr(embedding.C, "stored", lambda df, name: made.update({name: df}) or real(df, name))
    got = result(embedding.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), cell=20, block=16))
    assert got == brute(rows) and sum(n for _, n, _, _ in got) > 0
    blocks = [(r.block, len(r.ids) // 8) for r in made["embedding-blocks"].select("block", "ids").collect()]
    assert sum(n for _, n in blocks) == 600 and len(blocks) == len(set(blocks)) > 30
    assert "hashpartitioning" not in made["embedding-links"]._jdf.queryExecution().executedPlan().toString()


def test_links_of_a_task_are_summed():
    ids, links, other = embedding._summed([(np.array([5, 7, 9]), np.array([1, 2, 1]), np.array([5, 5, 9])), (np.array([7, 8, 20]), np.array([3, 3, 1]), np.array([7, 7, 20]))])
    assert list(zip(ids.tolist(), links.tolist(), other.tolist())) == [(5, 1, 5), (7, 5, 5), (8, 3, 5), (9, 1, 9), (20, 1, 20)]


def test_far_cells_do_not_meet(spark, monkeypatch):
    """Three narrow bundles of vectors: only blocks of one bundle are joined."""
    r = np.random.default_rng(6)
    rows = [(i, (np.eye(4)[i % 3] + r.normal(size=4) * 0.02).tolist()) for i in range(300)]
    made, real = {}, embedding.C.stored
    monkeypatch.setattr(embedding.C, "stored", lambda df, name: made.update({name: df}) or real(df, name))
    assert result(embedding.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=25, block=1024)) == brute(rows)
    blocks = made["embedding-blocks"].select("cell", "meets").collect()
    assert all(r.cell in r.meets for r in blocks) and sum(len(r.meets) for r in blocks) < len(blocks) ** 2 / 2
