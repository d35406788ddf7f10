import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arcwright.llm import lm
from arcwright.llm.common import read

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HELD = "crc32(cast(doc_id as string)) % 7 = 2"


def brute(rows):
    """Counts and base scores of (doc_id, text, held_out)."""
    split = [(i, [*WORD.findall((t or "").translate(LOW)), None], h) for i, t, h in rows]
    c = Counter(w for _, ws, h in split if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws, h in split), key=str)


def brute_scores(rows):
    """Scores of (doc_id, text, held_out) by the model as it is told, with tables of exact bigram counts in place of the filter."""
    split = [(i, [None, *WORD.findall((t or "").translate(LOW)), None], h) for i, t, h in rows]
    c, g = Counter(), Counter()
    for _, ws, h in split:
        if not h:
            c.update(ws[1:])
            g.update(zip(ws, ws[1:], strict=False))
    n, v = sum(c.values()), len(c)
    level = {k: x.bit_length() for k, x in g.items()}
    by = {}
    for k, q in level.items():
        by.setdefault(q, []).append(g[k])
    mean = {q: sum(x) / len(x) for q, x in by.items()}
    magnitude = lambda x: int(np.searchsorted(lm.MAGNITUDES, x, "right"))
    best, fit = {}, {}
    for _, ws, h in split:
        for a, w in () if h else zip(ws, ws[1:], strict=False):
            if c[a] > 1:
                share, p1 = min(1, max(mean[level[a, w]] - 1, 0) / (c[a] - 1)), (c[w] + 1) / (n + v + 1)
                x = fit.setdefault(magnitude(c[a] - 1), np.zeros(len(lm.WEIGHTS)))
                x += np.log10(lm.WEIGHTS * share + (1 - lm.WEIGHTS) * p1)
    best = {k: lm.WEIGHTS[x.argmax()] for k, x in fit.items()}
    out = []
    for i, ws, h in split:
        score = 0.0
        for a, w in zip(ws, ws[1:], strict=False):
            p = (c[w] + 1) / (n + v + 1)
            if c[a]:
                q = best.get(magnitude(c[a]), lm.WEIGHTS[0])
                p = q * min(1, mean[level[a, w]] / c[a] if (a, w) in level else 0) + (1 - q) * p
            score += math.log10(p)
        out.append((i, h, score))
    return sorted(out, key=str)


def test_filter_levels_are_never_low():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 20000).astype(np.uint64))
    n = rng.zipf(1.5, len(h)).clip(1, 10**9)
    slices = [lm.bloom(h[::2], n[::2]), lm.bloom(h[1::2], n[1::2])]
    data, base = np.concatenate(slices), np.where(np.arange(len(h)) % 2, len(slices[0]), 0)
    bits = np.where(np.arange(len(h)) % 2, 8 * len(slices[1]), 8 * len(slices[0]))
    level = lm.probe(h, data, base, bits)
    assert (level >= lm.levels(n)).all() and (level > lm.levels(n)).mean() < 0.03
    assert (lm.probe(rng.integers(0, 1 << 63, 20000).astype(np.uint64), data, 0, 8 * len(slices[0])) > 0).mean() < 0.03
    assert not lm.probe(h, data, base, 0).any()


@pytest.mark.parametrize("most", [lm.FILTER_BYTES, 0], ids=["broadcast", "asked"])
def test_counts_and_scores_against_brute_force(spark, sf, most):
    docs = read(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.h) for r in docs.selectExpr("doc_id", "text", f"{HELD} as h").collect()]
    got = sorted(lm.scores(docs, HELD, most, bits=400).collect(), key=lambda r: str((r.doc_id, r.held_out)))
    for g, w in zip(got, sorted(brute(rows), key=lambda w: str(w[:2])), strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
    for g, w in zip(got, sorted(brute_scores(rows), key=lambda w: str(w[:2])), strict=True):
        assert (g.doc_id, g.held_out) == w[:2] and g.score == pytest.approx(w[2], rel=1e-9)


def test_both_ways_agree_and_the_model_gains(spark, sf):
    docs = read(spark, sf, "documents")
    one, two = (sorted(map(tuple, lm.scores(docs, HELD, most).collect())) for most in (lm.FILTER_BYTES, 0))
    assert one == two
    assert all(r[6] <= 0 for r in one) and sum(r[6] for r in one if r[1]) > sum(r[5] for r in one if r[1])


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_collide_in_polynomials(spark, n):
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    held = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(ids[0], f"{word} x"), (ids[1], "y z"), (held, f"{other} x")]
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), HELD).collect()}
    assert got[held].n_known == 2 and got[held].train_tokens == 6 and got[ids[0]].n_known == 3


def test_counts_of_words_whose_first_lane_collides():
    known = np.array([[5, 5, 5, 9], [1, 2, 4, 7]], np.uint64)
    asked = np.array([[5, 5, 5, 5, 9, 9, 10, 0], [2, 1, 3, 4, 7, 8, 0, 0]], np.uint64)
    assert lm._looked_up(known, np.array([10, 20, 30, 40]), asked).tolist() == [20, 10, 0, 30, 40, 0, 0, 0]


def test_odd_cases(spark, odd):
    odd = odd.unionByName(spark.createDataFrame([(None, "a text without an id", None, None, None, None, None)], odd.schema))
    rows = [(r.doc_id, r.text, bool(r.h)) for r in odd.selectExpr("doc_id", "text", f"{HELD} as h").collect()]
    got = lm.scores(odd, HELD).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got), key=str) == sorted((w[:5] for w in brute(rows)), key=str)
    assert lm.scores(odd.limit(0), HELD).collect() == []
    untrained = lm.scores(odd, "true").collect()
    assert all(r.score == pytest.approx(r.base_score) and r.train_tokens == 0 for r in untrained)
