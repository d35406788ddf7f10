"""Every query of curves against its SQL; those without SQL give rows."""

import math

import duckdb
import pytest

from arcwright.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(0.0 if x == 0 else x for x in (r[i] for i in order)) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    got = rows(df.columns, df.collect())
    assert got
    if name in ORACLE_SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
        con.execute(ORACLE_SQL[name])
        names = [d[0] for d in con.description]
        assert sorted(names) == sorted(df.columns)
        want = rows(names, con.fetchall())
        assert len(got) == len(want)
        number = lambda r: tuple(-1e300 if x is None else float(x) for x in r)
        for g, w in zip(sorted(map(number, got)), sorted(map(number, want)), strict=True):
            assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6) for a, b in zip(g, w, strict=True)), (g, w)
