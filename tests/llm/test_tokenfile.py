import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from arcwright.llm import tokenfile
from arcwright.llm.common import read

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_as_the_library(spark, library):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = sorted(tuple(r) for r in tokenfile.written(docs, PATH, 2).collect())
    assert got == want(library, sorted(tuple(r) for r in docs.select("doc_id", "text").collect()))


def test_odd_texts_and_files(spark, odd, library, tmp_path):
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0], r[1] or ""))
    data = tokenfile.write(odd, PATH, 2, str(tmp_path / "d"))
    got = sorted(tuple(r) for r in tokenfile.read_back(spark, data).collect())
    assert got == want(library, rows)
    offsets = np.concatenate([np.fromfile(p, "<u8")[:-1] for p in sorted((tmp_path / "d").glob("*.offsets"))])
    assert offsets.tolist() == [r[1] for r in got]
    assert tokenfile.written(odd.limit(0), PATH, 2).collect() == []
    null = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted((str(r[0]), r[1], r[2]) for r in tokenfile.written(null, PATH, 2).collect()) == [("1", 3, 1), ("None", 0, 3)]


def test_least_ids_and_nulls(spark, library, tmp_path):
    rows = [(-(2**63), "least"), (None, "a b"), (5, "c"), (None, None), (2**63 - 1, "d"), (0, "zero")]
    data = tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 2, str(tmp_path / "d"))
    got = [tuple(r) for r in tokenfile.read_back(spark, data).collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert sorted(got, key=lambda r: r[1]) == want(library, ordered)


def test_one_id_of_many_texts_is_dealt_to_several_files(spark, library, tmp_path):
    rows = [(7, f"{i:05d} text") for i in range(2000)]
    data = tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH, 2, str(tmp_path / "d"))
    assert len(data.parts) > 3
    assert sorted((tuple(r) for r in tokenfile.read_back(spark, data).collect()), key=lambda r: r[1]) == want(library, rows)


def test_words_are_kept_up_to_a_bound_of_bytes(library, monkeypatch):
    monkeypatch.setattr(tokenfile, "KEEP_BYTES", 1000)
    e = tokenfile.LibraryEncoder(PATH)
    for i in range(20):
        text = " ".join(chr(97 + i) * 40 + chr(97 + j) for j in range(10))
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert sum(map(len, e.known)) < 2000


def test_random_texts(library):
    r = random.Random(5)
    pools = ["abcDEFgh THE ing", "  \n\t x", "0123456789,.;'!", "ÉÜñÇßøаБ数字😀İΣςÅ̀́", "՘Ɤ\U00010950 aA", "'s'T're'VE'm'll'd ", "<|endoftext|>"]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(60))) for _ in range(3000)]
    e = tokenfile.LibraryEncoder(PATH)
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_ranges_of_a_store_without_mapping(monkeypatch, tmp_path):
    lengths = [3, 1, 50, 2, 2, 2, 2]
    edges, ids = np.concatenate([[0], np.cumsum(lengths)]), np.arange(62, dtype="<u2")
    ids.tofile(tmp_path / "x.tokens")
    monkeypatch.setattr(tokenfile, "READ_DOCS", 3)
    monkeypatch.setattr(tokenfile, "READ_IDS", 10)
    mapped = [(i, j, t.tolist()) for i, j, t in tokenfile._ranges(str(tmp_path), "x.tokens", "<u2", edges)]
    assert [m[:2] for m in mapped] == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert [x for m in mapped for x in m[2]] == ids.tolist()
    other = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(tokenfile, "_place", lambda uri: (other, ""))
    assert [(i, j, t.tolist()) for i, j, t in tokenfile._ranges("any", "x.tokens", "<u2", edges)] == mapped
