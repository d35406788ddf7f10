import random
import re

import numpy as np
import pytest

from arcwright.llm import components, minhash
from arcwright.llm.common import read

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent, size=5):
    """Sets and components by all pairs that share a shingle."""
    sets = {}
    for doc_id, text in rows:
        w = re.findall("[^ \t-\r]+", (text or "").translate(LOW))
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.setdefault(doc_id, []).append(s)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for d, own in sets.items():
        for s in own:
            for x in s:
                by.setdefault(x, []).append((d, s))
    for d, own in sets.items():
        for s in own:
            seen = {}
            for x in s:
                for e, t in by[x]:
                    seen.setdefault((e, id(t)), t)
            for (e, _), t in seen.items():
                n = len(s & t)
                if 100 * n >= percent * (len(s) + len(t) - n):
                    a, b = root(d), root(e)
                    parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), root(d), d == root(d)) for d, own in sets.items() for s in own)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def family(n, words=150, seed=0):
    """Copies of one text with more and more words changed, and copies of copies."""
    r = random.Random(seed)
    w = [f"w{r.randrange(10_000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(w)
        for _ in range(r.randrange(0, 12)):
            own[r.randrange(words)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    r.shuffle(rows)
    return rows


def test_documents_against_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = result(minhash.groups(docs, percent=85))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 85)
    assert got == want
    assert sum(not r[3] for r in want) > 20


@pytest.mark.parametrize("block", [128, 16])
def test_a_large_group(spark, block):
    rows = family(120) + [(1000 + i, t) for i, t in family(60, seed=1)] + [(5000 + i, "one and the same text of a few words") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.groups(docs, percent=85, block=block)) == brute(rows, 85)


def test_odd_cases(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(minhash.groups(odd, percent=85)) == brute(rows, 85)
    assert minhash.groups(odd.limit(0)).collect() == []
    null = spark.createDataFrame([(None, "a b c"), (None, None), (4, "a b c"), (6, "A b c")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in minhash.groups(null).collect())))
    assert got == sorted(map(str, [(None, 1, None, True), (None, 0, None, True), (4, 1, 4, True), (6, 1, 4, False)]))


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64))
    b = np.concatenate([a[:240], np.unique(r.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64))])
    edges = np.array([0, len(a), len(a) + len(b), len(a) + len(b), len(a) + len(b) + 1])
    sig = minhash.signatures(np.concatenate([a, b, a[:1]]), edges, 120)
    assert (sig[2] == minhash.EMPTY).all() and (sig[3] != minhash.EMPTY).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15


def thue_morse(n, letters="ab"):
    """A word and its complement: polynomials modulo powers of two give both one value."""
    word = "".join(letters[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


@pytest.mark.parametrize("n", [1024, 2048])
def test_texts_of_words_that_collide_in_polynomials(spark, n):
    a, b = thue_morse(n)
    rows = [(1, " ".join([a] * 3)), (2, " ".join([b] * 3)), (3, f"{a} x y z u {b}"), (4, f"{b} x y z u {a}"), (5, f"{a} x y z u {b}")]
    assert result(minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 80)


def test_elements_are_told_apart_by_both_lanes():
    one = np.array([5, 5, 7, 5, 7], np.uint64)
    two = np.array([1, 2, 3, 1, 3], np.uint64)
    number, count = minhash.numbered(one, two)
    assert number[0] == number[3] != number[1] and number[2] == number[4] and sorted(count.tolist()) == [1, 2, 2]
    sets = [np.array([[1, 2, 3], [9, 9, 9]], np.uint64), np.array([[1, 2, 3], [8, 8, 8]], np.uint64), np.array([[1, 2, 3], [9, 9, 9]], np.uint64)]
    assert minhash.linked(sets, 80).tolist() == [0, 1, 0]


def test_components_in_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(components.connected, "__defaults__", (0,))
    rows = family(60, seed=3) + [(100 + i, t) for i, t in family(20, seed=4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(minhash.groups(df, percent=85, block=16)) == brute(rows, 85)


def test_one_text_many_times(spark):
    n = 100_000
    df = spark.range(n).selectExpr("id as doc_id", "'one two three four five six seven' as text").unionByName(spark.createDataFrame([(n, "other words that nobody else has here")], "doc_id long, text string"))
    got = minhash.groups(df)
    assert got.where("component_id = 0 and n_shingles = 3 and kept = (doc_id = 0)").count() == n
    assert got.where("kept").count() == 2
