import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import pytest

from arcwright.llm import common as C
from arcwright.llm import decontam
from arcwright.llm.common import read

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        if item is not None and w:
            m = min(size, len(w))
            for i in range(len(w) - m + 1):
                windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if got := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [10, 3])
def test_against_brute_force(spark, size):
    docs, bench = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "benchmark")
    want = brute(docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect(), size)
    assert result(decontam.contamination(docs, bench, size)) == want
    assert size > 3 or sum(r[2] > 0 for r in want) > 10


def test_odd_cases_and_blocks(spark, odd, monkeypatch):
    rows = [(1, "Same ROW"), (1, "a b"), (2, None), (3, ""), (None, "word"), (4, "word word " * 8), (5, "twice"), (6, "1 2 3 4 5 6 7 8 9 10 é 數字"), (7, "ab" * 700)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    want = brute([(r.doc_id, r.text) for r in odd.collect()], rows)
    assert result(decontam.contamination(odd, bench)) == want
    assert any(r[5] for r in want)
    dirty = {r[0] for r in want if r[5]}
    kept = decontam.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if not r[5])
    assert dirty
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (40,))
    assert result(decontam.contamination(odd, bench)) == want


def test_empty_tables(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.contamination(odd, none).collect())
    assert decontam.contamination(odd.limit(0), none).collect() == []


def test_a_full_block_takes_bounded_memory():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9))) for _ in range(50_000)]
    items, size = [], 0
    while size < decontam.BLOCK_BYTES:
        items.append((str(len(items)), " ".join(r.choices(words, k=2000))))
        size += len(items[-1][1])
    tracemalloc.start()
    m = decontam.Matcher(items, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30
    held = sum(a.nbytes for t, of in zip(m.tables, m.of_window, strict=True) for a in (t.shift, t.suffixes, t.whole, t.first, t.order, of)) + m.data.nbytes + sum(a.nbytes for a in m.words)
    held += sum(x.nbytes for lists in m.lists for x in lists)
    assert held < 20 * decontam.BLOCK_BYTES + (1 << decontam.SHIFT_BITS)


def test_clashing_columns_and_null_ids(spark):
    bench = spark.createDataFrame([(1, "some benchmark words")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "here are some benchmark words", "x", "y"), (None, "clean", "p", "q")], "doc_id long, text string, _text string, items string")
    assert [tuple(r) for r in decontam.decontaminate(docs, bench).collect()] == [(None, "clean", "p", "q")]
    assert sorted(r.contaminated for r in decontam.contamination(docs, bench).collect()) == [False, True]


def test_blocks_of_items_that_share_windows(spark, monkeypatch):
    """Items of several blocks found in one document, also by the same words, are told together."""
    r = random.Random(4)
    words = ["w%d" % i for i in range(30)]
    items = [(i, " ".join(r.choices(words, k=r.choice([2, 12, 14])))) for i in range(60)]
    items += [(100 + i, items[i % 7][1]) for i in range(20)] + [(200, items[0][1] + " tail"), (3, items[5][1])]
    docs = [(i, " ".join(items[r.randrange(len(items))][1] for _ in range(r.choice([0, 1, 4])))) for i in range(80)] + [(None, items[0][1]), (7, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute(docs, items)
    assert result(decontam.contamination(table, bench)) == want
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (1000,))
    monkeypatch.setattr(decontam, "ITEMS", 3)
    assert len(list(decontam.item_blocks(bench))) > 2
    assert result(decontam.contamination(table, bench)) == want
    found = decontam.matches(table, bench).collect()
    assert sorted(r.n_words for r in found) == sorted(d[1] for d in want) and all(len(r.hits) == -(-r.n_words // 8) for r in found)


def test_very_many_items_with_one_window():
    """20,000 items that share their only window against 2 MB of text full of it: candidates grow with places alone."""
    window = "one two three four five six seven eight nine ten"
    tracemalloc.start()
    begin = time.process_time()
    m = decontam.Matcher([(str(i), window) for i in range(20_000)], 10)
    data = C.lower_table()[np.frombuffer((" ".join([window, "x"] * 40_000)).encode(), np.uint8)]
    assert len(data) > 2_000_000
    offsets = np.array([0, len(data)])
    w = C.words(data, offsets, C.alnum_words())
    hit = np.zeros(len(w.doc), bool)
    (found,) = m.find(data, w, offsets, hit)
    took, peak = time.process_time() - begin, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hit.sum() == 400_000 and len(m.items(found)) == 20_000 and len(found) == 1
    assert took < 10 and peak < 1 << 30, (took, peak)
