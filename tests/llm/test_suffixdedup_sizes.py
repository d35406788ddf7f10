"""Strings that begin at the 64th byte of a window or later are marked as well."""

import random

import pytest
from test_suffixdedup import brute, result

from arcwright.llm import suffixdedup


@pytest.mark.parametrize("size", [124, 125, 130, 300])
def test_long_strings(spark, size):
    r = random.Random(size)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(40):  # pairs that share a string a little longer than size, between texts of their own
        shared = word(size + i % 3)
        rows += [(2 * i, word(150) + shared + word(200)), (2 * i + 1, word(170) + shared + word(90))]
    rows += [(100, rows[0][1] + word(50)), (101, rows[0][1])]
    want, kept = brute(rows, size)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(suffixdedup.removals(df, size)) == want
    assert {x.doc_id: x.text.encode() for x in suffixdedup.remove(df, size).collect()} == kept
    assert sum(w[2] > 0 for w in want) >= 40
