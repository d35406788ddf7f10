"""Whole texts in the forms in which they are published."""

import re
from importlib import resources
from pathlib import Path

import duckdb
import pyarrow as pa

from arcwright.llm import licenses


def test_published_files(spark):
    texts = dict(licenses.TEXTS)
    file = lambda i: (resources.files("arcwright.llm") / "license_texts" / f"{i}.txt").read_text("utf-8")
    apache = file("Apache-2.0")
    docs = {
        "MIT": [
            "MIT License\n\nCopyright (c) 2024 X\n\n" + texts["MIT"],
            "The MIT License (MIT)\r\n\r\nCopyright The X Authors\r\n\r\n" + texts["MIT"].replace("\n", "\r\n"),
            "Copyright The X Authors. All rights reserved.\n" + texts["MIT"].replace('"AS IS"', "“AS IS”"),
            "﻿MIT License\n\nCopyright © X Y\n\n" + texts["MIT"],
            "Copyright (c) 2024 X\n" + texts["MIT"].replace(" COPYRIGHT", "\nCOPYRIGHT"),
            "Copyright The X Authors\n" + texts["MIT"].replace(" COPYRIGHT", "\nCOPYRIGHT").replace(" copyright", "\ncopyright"),
        ],
        "ISC": ["ISC License (ISC)\nCopyright 2004-2010 by X\n" + texts["ISC"].replace("and/or", "and")],
        "BSD-2-Clause": ["BSD 2-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + texts["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")],
        "BSD-3-Clause": ["BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + file("BSD-3-Clause"), "Copyright X, Inc.\n" + file("BSD-3-Clause"), re.sub(r"(?m)^[123]\. ", "* ", file("BSD-3-Clause"))],
        "Apache-2.0": [apache, apache[: apache.index("END OF TERMS")], apache[apache.index("TERMS AND") :], apache.replace("[yyyy] [name of copyright owner]", "2021 X").replace("http:", "https:")],
        "MPL-2.0": [file("MPL-2.0"), file("MPL-2.0").split("Exhibit A -")[0]],
        "GPL-3.0": [file("GPL-3.0"), file("GPL-3.0").split("How to Apply These")[0].replace('"', "”")],
        **{i: [file(i)] for i in ("Artistic-1.0-Perl", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "Unlicense", "Zlib")},
    }
    want = [i for i, forms in docs.items() for _ in forms]
    other = ["MIT License", "Copyright The X Authors", "MIT License\n" + texts["MIT"] + "\nand more", "“ © ”"]
    rows = list(enumerate([x for forms in docs.values() for x in forms] + other))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].license_id for k, _ in rows] == want + [None] * len(other)
    assert all(got[k].n_notices == 0 for k, _ in rows)


def test_each_form_has_one_license(spark):
    known = licenses.known_licenses(spark)
    forms = known.select("license_id", licenses.canonical(known.text).alias("form")).distinct().collect()
    assert len({r.form for r in forms}) == len(forms)


def test_sql_and_scan_name_the_same_files(spark):
    """All stated texts, and published files as they lie on this machine, through both."""
    found = [p for root in ("/opt", "/usr/share") for p in sorted(Path(root).rglob("*")) if re.match(r"(?i)(licen[sc]e|copying|copyright|notice)", p.name) and p.is_file() and p.stat().st_size < 200_000]
    texts = {p.read_bytes().decode("utf-8", "replace").replace("\r", "") for p in found[:1500]} | {t for _, t in licenses.stated_licenses()}
    rows = list(enumerate(sorted(texts)))
    got = sorted((tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("doc_id", "license_id", "n_notices", "licenses").collect()))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    want = sorted(con.execute(licenses.oracle_sql()).fetchall())
    assert got == want
    assert sum(r[1] is not None for r in got) > 200


def test_a_shuffled_table_of_licenses_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, licenses.TEXTS[2][1]), (2, "\n\n\n"), (3, None), (4, "x\n\nReleased under the MIT License.\n\n"), (None, "")], "doc_id long, text string")
    plain = sorted(map(repr, licenses.scan(docs).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, licenses.scan(docs).collect())) == plain and len(plain) == 5
