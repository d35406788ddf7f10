import hashlib
import random

import numpy as np
import pytest

from arcwright.llm import suffixdedup, suffixes
from arcwright.llm.common import read


def brute(rows, size=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            s = b[k : k + size]
            first[s] = min(first.get(s, i), i)
    out, texts = [], {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone[k : k + size] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        texts[i] = kept
    return sorted(out), texts


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_documents_against_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    want, _ = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert result(suffixdedup.removals(docs)) == want
    assert sum(r[2] > 0 for r in want) > 10


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("ab é") for _ in range(r.randrange(5, 140))) for _ in range(12)]
    rows = [(r.randrange(10**6), "".join(r.choice(pool) for _ in range(r.randrange(0, 6)))) for _ in range(60)]
    rows = list({i: t for i, t in rows}.items())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, kept = brute(rows)
    assert result(suffixdedup.removals(df)) == want
    left = {x.doc_id: x.text for x in suffixdedup.remove(df).collect()}
    for i, t in left.items():
        assert kept[i].decode(errors="ignore") in t or len(t.encode()) - len(kept[i]) < 12


def test_odd_cases(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want, _ = brute(rows)
    assert result(suffixdedup.removals(odd)) == want
    kept = suffixdedup.remove(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert suffixdedup.removals(odd.limit(0)).collect() == [] and suffixdedup.remove(odd.limit(0)).collect() == []
    null = spark.createDataFrame([(None, "z" * 80), (3, "z" * 80), (2, "y" * 9 + "z" * 60), (None, None)], "doc_id long, text string")
    got = sorted(tuple(r)[1:4] for r in suffixdedup.removals(null).collect())
    assert got == sorted([(80, 0, 0), (80, 80, 1), (69, 0, 0), (0, 0, 0)])


def brute_order(t):
    ends = np.flatnonzero(t == 0)
    keys = [(t[i : ends[k]].astype(">u2").tobytes() + b"\0\0", k) for i, k in ((i, int(np.searchsorted(ends, i))) for i in range(len(t)))]
    return sorted(range(len(t)), key=lambda i: keys[i])


def side_by_side(windows):
    return np.array([x for w in windows for x in [*(b + 1 for b in w), 0]], np.uint16)


def test_suffix_array_against_sorting():
    r = np.random.default_rng(0)
    for _ in range(200):
        t = side_by_side([bytes(r.integers(97, 97 + r.integers(1, 4), r.integers(0, 30)).astype(np.uint8)) for _ in range(r.integers(1, 6))])
        assert suffixes.suffix_array(t, 258).tolist() == brute_order(t)


@pytest.mark.parametrize(
    "windows",
    [[b"ab" * 700 + b" " + b"ab" * 700], [b"x" * 5000, b"x" * 4000], [b"word " * 1000], [bytes(range(32, 127)) * 20, bytes(range(126, 31, -1)) * 20]],
    ids=["period", "one byte", "word", "up and down"],
)
def test_suffix_array_of_regular_texts(windows):
    t = side_by_side(windows)
    assert suffixes.suffix_array(t, 258).tolist() == brute_order(t)


def test_large_alphabets_are_sorted_by_the_same_induction(monkeypatch):
    r = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(2000)]
    windows = [" ".join(words[k] for k in r.integers(0, 2000, 400)).encode() for _ in range(40)]
    windows += windows[:5]
    t, symbols = side_by_side(windows), []
    own = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda t, k: symbols.append(k) or own(t, k))
    assert suffixes.suffix_array(t, 258).tolist() == brute_order(t)
    assert symbols[0] == 258 and len(symbols) > 1 and max(symbols[1:]) > 512


def test_runs_of_one_hash_are_told_apart_by_bytes(monkeypatch):
    texts = [b"a" * 60, b"b" * 60, b"a" * 60, b"c" * 61, b"b" * 60]
    n = np.array([len(x) for x in texts])
    monkeypatch.setattr(suffixdedup.C, "range_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    order, new = suffixdedup._Runs(np.arange(5), np.arange(5), np.zeros(5, int), n, np.frombuffer(b"".join(texts), np.uint8)).classes()
    seen = {}
    for i, c in zip(order.tolist(), np.cumsum(new).tolist(), strict=True):
        assert seen.setdefault(c, texts[i]) == texts[i]


def hot(n=120):
    """Exact and near copies of one text in most rows, a passage that many share, and texts of their own."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    base, passage, rows = [word() for _ in range(300)], " ".join(word() for _ in range(40)), []
    for i in range(n):
        own = list(base)
        for _ in range(i % 3):
            own[r.randrange(300)] = word()
        rows += [(3 * i, " ".join(own)), (3 * i + 1, " ".join([*(word() for _ in range(60)), passage, *(word() for _ in range(60))])), (3 * i + 2, " ".join(word() for _ in range(80)))]
    return rows


@pytest.mark.parametrize("most", [suffixdedup.ARRAY_BYTES, 5000])
def test_hot_passages_in_many_buckets_and_several_arrays(spark, most):
    rows = hot()
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # buckets: more than SPREAD
    try:
        want, kept = brute(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert result(suffixdedup.removals(df, most=most)) == want
        assert {x.doc_id: x.text.encode() for x in suffixdedup.remove(df, most=most).collect()} == kept
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_clashing_columns_and_repeated_ids(spark):
    t = "one passage of more than fifty bytes that several documents have, "
    rows = [(1, t + "a", "x"), (1, t + "b", "y"), (1, t + "a", "z"), (2, t * 3, "w"), (0, "short", None)]
    names = ["_text", "_id", "_b", "b", "id", "row"]
    df = spark.createDataFrame([(i, x, *[c] * len(names)) for i, x, c in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = sorted(suffixdedup.remove(df).collect(), key=str)
    assert df.columns == list(got[0].asDict())
    assert sorted((r.doc_id, r.text, *(r[n] for n in names)) for r in got if r.doc_id == 1) == sorted((i, x, *[c] * len(names)) for i, x, c in rows if i == 1)
    assert [r.text for r in got if r.doc_id == 2] == [""]
