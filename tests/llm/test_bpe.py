import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arcwright.llm import bpe
from arcwright.llm.common import read

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def want(library, texts):
    out = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


def test_documents_as_the_library(spark, library):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert [got[r.doc_id] for r in rows] == want(library, [r.text for r in rows])


def test_odd_texts(spark, odd, library):
    rows = odd.collect()
    got = sorted((tuple(r) for r in bpe.digests(odd, PATH).collect()), key=str)
    assert got == sorted(((r.doc_id, *w) for r, w in zip(rows, want(library, [r.text for r in rows]), strict=True)), key=str)
    full = {(r.doc_id, r.decoded) for r in bpe.encoded(odd, PATH).collect()}
    assert full == {(r.doc_id, r.text or "") for r in rows}
    assert bpe.digests(odd.limit(0), PATH).collect() == []


def test_random_texts(library):
    r = random.Random(3)
    pools = ["abcdefgh the ing", "  \n\t x", "0123456789,.;'!", "éüñçßøаб数字😀̀́", "՘Ɤ\U00010950 aA", "'s't're've'm'll'd ", "<|endoftext|>"]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(60))) for _ in range(3000)]
    e = bpe.Encoder(PATH)
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
        assert e.decode(ids) == t


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_unknown_kinds_of_vocabulary_are_errors(change, tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f) | change
    (tmp_path / "v.json").write_text(json.dumps(spec), "utf-8")
    with pytest.raises(ValueError, match="pre-tokenizer"):
        bpe.Vocabulary(str(tmp_path / "v.json"))


@pytest.mark.parametrize("change", [{"ignore_merges": True}, {"byte_fallback": True}, {"end_of_word_suffix": "</w>"}, {"dropout": 0.1}, {"lstrip": True}])
def test_vocabularies_of_other_kinds_are_refused(tmp_path, change):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for k, v in change.items():
        (spec["added_tokens"][0] if k == "lstrip" else spec["model"])[k] = v
    (tmp_path / "v.json").write_text(json.dumps(spec), "utf-8")
    with pytest.raises(ValueError, match="known"):
        bpe.Vocabulary(str(tmp_path / "v.json"))
