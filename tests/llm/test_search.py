import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from arcwright.llm import common as C
from arcwright.llm import search as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def brute(docs, items, k=20):
    """Rows of all documents scored for each item; docs and items are (id, text)."""
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    joined = {}
    for i, t in items:
        if i is not None:
            joined.setdefault(i, []).extend(terms(t))
    out = []
    for i, asked in joined.items():
        scored = []
        for doc, bag, n in bags:
            m = 75 + 25 * n * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in asked if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(i, r, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, term string, score int").repartition(5)
    i = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in S.search(d, i, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300, "block_bytes": 200, "k": 3}])
def test_ranks_against_scoring_all(spark, options):
    r = random.Random(5)
    word = lambda: "w%d" % int(r.paretovariate(0.6) % 400)
    docs = [(i, " ".join(word() for _ in range(r.choice([1, 3, 20, 200])))) for i in range(300)]
    docs += [(1000 + i, docs[0][1]) for i in range(60)] + [(None, docs[0][1]), (5, docs[0][1]), (2000, None), (2001, ""), (2002, "-- !"), (2003, "W1 w1,W1;w1 É é")]
    docs += [(3000, " ".join(word() for _ in range(5000)))]
    items = [(i, " ".join(word() for _ in range(r.choice([1, 8, 40])))) for i in range(40)]
    items += [(50, docs[0][1]), (51, "w1 w1 w1 w2"), (52, None), (53, "?"), (54, "unknown"), (None, "w1"), (51, "w3 É")]
    assert found(spark, docs, items, **options) == brute(docs, items, options.get("k", 20))


def test_odd_texts(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(i, t) for i, (_, t) in enumerate(docs)]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_ids_of_items_of_any_type(spark):
    d = spark.createDataFrame([(-(2**63), "a b"), (None, "a")], "doc_id long, text string")
    i = spark.createDataFrame([("x", "a"), (None, "b")], "item_id string, text string")
    assert {(r.item_id, r.doc_id) for r in S.search(d, i).collect()} == {("x", None), ("x", -(2**63))}


def test_documents_that_cannot_qualify_are_not_scored():
    """With a score to reach, lists of terms that can't reach it together are only probed, and nothing is lost."""
    r = np.random.default_rng(3)
    n, terms = 400, 30
    held = r.random((terms, n)) < np.linspace(0.9, 0.02, terms)[:, None]
    term, doc = np.nonzero(held)
    start = C.starts_of(term)
    row = {
        "large": False, "ids": np.stack([np.ones(n, np.int64), np.arange(n)]).tobytes(), "lengths": np.full(n, 50, np.int64).tobytes(), "terms": term[start].astype("<u4").tobytes(),
        "counts": np.diff(np.append(start, len(term))).astype("<u4").tobytes(), "docs": doc.astype("<u2").tobytes(), "times": r.integers(1, 4, len(doc)).astype("<u2").tobytes(),
    }
    shard = S.Shard(row, np.linspace(10, 4000, terms).astype(np.int64), n, 50 * n)
    asked, repeats = np.arange(terms), np.ones(terms, np.int64)
    docs, scores = shard.ranked(asked, repeats, 1)
    least = int(np.sort(scores)[-20])
    some, again = shard.ranked(asked, repeats, least)
    assert dict(zip(some.tolist(), again.tolist(), strict=True)) == {d: s for d, s in zip(docs.tolist(), scores.tolist(), strict=True) if s >= least}
    assert len(shard.ranked(asked, repeats, 10**15)[0]) == 0
