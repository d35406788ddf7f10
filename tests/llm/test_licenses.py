import duckdb

from arcwright.llm import licenses
from arcwright.llm.common import read


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "license_id", "n_notices", "licenses").collect()), key=str)


def oracle(table):
    con = duckdb.connect()
    con.register("documents", table)
    return sorted(con.execute(licenses.oracle_sql()).fetchall(), key=str)


def test_against_sql(spark, sf):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = rows(licenses.scan(docs))
    assert got == oracle(docs.select("doc_id", "text").toArrow())
    assert sum(r[2] > 0 for r in got) > 5


def test_texts_in_other_forms(spark, odd):
    texts = dict(licenses.TEXTS)
    forms = [
        "Copyright (c) 2020, 2021 Some One <a@b.c>\n\n" + texts["MIT"].replace("sublicense", "sub-license"),
        "© 1999 X\nAll rights reserved.\n" + texts["BSD-2-Clause"].upper().replace(" ", "  \n "),
        "  // " + texts["ISC"].replace("\n", "\n  // "),
        texts["MIT"] + " and more",
        "text\nLicensed under the Apache Licence version 2.0\nreleased under the MIT license\n",
        "Copyright 2020 nobody",
    ]
    docs = odd.select("doc_id", "text", "hash").unionByName(spark.createDataFrame([(100 + i, t, "") for i, t in enumerate(forms)], "doc_id long, text string, hash string"))
    docs = docs.unionByName(spark.createDataFrame([(None, texts["0BSD"], "")], docs.schema))
    got = rows(licenses.scan(docs))
    of = {r[0]: r[1:] for r in got}
    assert of[100][0] == "MIT" and of[101][0] == "BSD-2-Clause" and of[102][0] == "ISC" and of[None][0] == "0BSD"
    assert of[103] == (None, 0, "") and of[104] == (None, 2, "Apache-2.0,MIT") and of[105] == (None, 0, "")
    assert got == oracle(docs.select("doc_id", "text").toArrow())


def test_empty_and_shuffled(spark, odd, monkeypatch):
    assert licenses.scan(odd.limit(0)).collect() == []
    none = spark.createDataFrame([], "license_id string, text string")
    assert all(r[1:] == (None, 0, "") for r in rows(licenses.scan(odd, none)))
    own = spark.createDataFrame([("x", "the same: row TWICE"), ("a", "The same row twice"), (None, "a"), ("e", "")], "license_id string, text string")
    want = rows(licenses.scan(odd, own))
    assert ("a" in {r[1] for r in want}) and "e" not in {r[1] for r in want}
    monkeypatch.setattr(licenses, "BROADCAST_BYTES", -1)
    assert rows(licenses.scan(odd, own)) == want
