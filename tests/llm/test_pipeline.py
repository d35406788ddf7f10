import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from arcwright.llm import toxicity
from arcwright.llm.common import read

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(texts):
    """Ids that near_duplicates keeps, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in texts}
    ids = sorted(sets)
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    changed = True
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(group[a], group[b])
            changed |= group[a] != m or group[b] != m
            group[a] = group[b] = m
    return {i for i in texts if group[i] == i}


def passages(texts):
    """Texts without bytes of 50 that a smaller id has; partial characters stay."""
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        own = [raw[k : k + 50] for k in range(len(raw) - 49)]
        gone = bytearray(len(raw))
        for k, s in enumerate(own):
            if s in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= set(own)
        kept = bytearray()
        k = 0
        while k < len(raw):  # a character goes only as a whole
            z = k + 1
            while z < len(raw) and raw[z] & 0xC0 == 0x80:
                z += 1
            if not all(gone[k:z]):
                kept += raw[k:z]
            k = z
        out[i] = kept.decode()
    return out


def test_stages_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    texts = {i: r.text for i, r in rows.items()}
    bad = {r.doc_id for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, read(spark, sf, "labels"))).where("score >= 0.7").collect()}
    assert 0 < len(bad) < len(texts) / 2
    texts = {i: t for i, t in texts.items() if i not in bad}
    keep = near(texts)
    assert len(keep) < len(texts)
    texts = passages({i: t for i, t in texts.items() if i in keep})
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for r in read(spark, sf, "benchmark").collect():
        w = word.findall((r.text or "").translate(LOW))
        m = min(10, len(w))
        windows |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
    sizes = {len(x) for x in windows}

    def clean(t):
        w = word.findall(t.translate(LOW))
        return not any(tuple(w[k : k + m]) in windows for m in sizes for k in range(len(w) - m + 1))

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation(), t.no_padding()
    want = []
    for i, x in texts.items():
        if clean(x):
            ids = t.encode(x, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in P.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_columns_and_odd_rows(spark, odd, sf):
    docs = odd.selectExpr("doc_id", "text", "lang", "source", "n_chars", "hash as _hash").unionByName(spark.createDataFrame([(None, "text without id", None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, _hash string"))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.where("doc_id is null").count() == 1
    assert P.STAGES[-1][1](spark, docs, sf).count() == docs.count()
    empty = docs.limit(0)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, empty, sf).collect() == []


@pytest.mark.parametrize("k", range(4))
def test_columns_of_any_name_pass_through(spark, sf, k):
    names = ["_text", "_score", "_gone", "_id", "_b", "_hash", "score", "row", "key", "id", "b", "cluster", "n", "label", "part.of", "label2"]
    rows = [(i, f"text number {i} with a few words of its own {i * 7919}", *[f"{n}-{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = P.STAGES[k][1](spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == rows
