import hashlib
import math

import pytest

from arcwright.llm import quantize as Q


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """vec_id, code, error, label_error and digest of (vec_id, embedding, label) of one length, in plain integers."""
    kept = sorted((i, [math.floor(scale * x) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e))
    size = len(kept[0][1]) // parts
    cut = lambda z, p: z[p * size : (p + 1) * size]
    books = [[cut(z, p) for _, z, _ in kept[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda z, p: min(range(len(books[p])), key=lambda e: (away(cut(z, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = {}
            for _, z, _ in kept:
                own.setdefault(near(z, p), []).append(cut(z, p))
            new.append([[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else b for e, b in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, "".join(f"{near(z, p):02x}" for p in range(parts)), sum(away(cut(z, p), books[p][near(z, p)]) for p in range(parts)), label) for i, z, label in kept]
    totals = {}
    for *_, error, label in out:
        totals[label] = totals.get(label, 0) + error
    return sorted((i, code, error, totals[label], digest) for i, code, error, label in out)


SCHEMA = "vec_id long, embedding array<float>, label int, key string, n int, code string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "c") for r in rows], SCHEMA)


def found(spark, rows, **options):
    return sorted(tuple(r) for r in Q.codes(table(spark, rows), **options).collect())


@pytest.mark.parametrize("n, dim", [(300, 16), (7, 8), (1, 24)])
def test_codes_against_plain_integers(spark, n, dim):
    import random

    r = random.Random(n)
    rows = [(i, [r.choice([-0.5, -0.25, 0.0, 0.125, r.uniform(-2, 2)]) for _ in range(dim)], r.choice([None, 0, 1])) for i in range(n)]
    rows += [(1000 + i, list(rows[0][1]), 1) for i in range(n // 3)]  # many equal vectors
    rows = [(i, [float(x) for x in __import__("numpy").float32(e)], label) for i, e, label in rows]
    odd = [(900, None, 1), (901, [None] * dim, 1), (902, [float("nan")] + [0.0] * (dim - 1), 1), (903, [float("inf")] * dim, None)]
    assert found(spark, rows + odd) == brute(rows)


def test_other_sizes(spark):
    rows = [(i, [float((i * k) % 11 - 5) for k in range(12)], None) for i in range(50)]
    assert found(spark, rows, scale=3, parts=4, entries=5, rounds=2) == brute(rows, 4, 5, 2, 3)


def test_odd_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == []
    (row,) = found(spark, [(1, [], 1)])
    assert row[:4] == (1, "00" * 8, 0, 0)
    two = found(spark, [(1, [1.0] * 8, 1), (2, [2.0] * 16, 1), (1, [1.0] * 8, 1)])
    assert [r[:3] for r in two] == [(1, "00" * 8, 0), (1, "00" * 8, 0), (2, "00" * 8, 0)] and two[0][4] != two[2][4]
    assert Q.codes(table(spark, [(None, [1.0] * 8, None)])).collect()[0].vec_id is None


def test_what_is_refused(spark):
    for rows in ([(1, [1.0] * 9, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(Exception, match="equal parts|at most"):
            found(spark, rows)
    with pytest.raises(ValueError, match="256"):
        Q.codes(table(spark, []), entries=257)


def test_distances_are_exact_near_the_bound():
    import numpy as np

    x = np.array([[Q.LARGEST] * 256, [-Q.LARGEST] * 256], np.int64)
    codes, errors = Q.nearest(x, np.array([[[-Q.LARGEST] * 256, [Q.LARGEST - 1] * 256]], np.int64))
    assert codes.tolist() == [[1], [0]] and errors.tolist() == [[256], [0]]
    _, far = Q.nearest(x[:1], np.array([[[-Q.LARGEST] * 256]], np.int64))
    assert far.tolist() == [[256 * (2 * Q.LARGEST) ** 2]]
