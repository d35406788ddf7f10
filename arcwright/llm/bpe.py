"""BPE encoding and decoding by last tokens over a trie of distinct words.

The encoding of a text by ranked merges has two properties: its prefix up to any token's edge is the encoding of that
prefix, and a sequence of tokens is an encoding exactly if each neighbouring pair is (merging the two tokens' bytes
gives the two back).  So each node of a trie of words has one last token: the token t that ends there and goes with
the last token of the node len(t) higher.  Distinct words in sorted order are the trie in depth-first order; states of
a shared prefix stay on the stack and are computed once.  A word's encoding is read backwards from its node.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows each give a row, as does one
with a null doc_id; a very long text is one text like any other; an empty table gives no rows; other columns aren't
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from .splitting import Splitter

#: Words, and bytes of words, whose encodings are kept at most, beside those of the texts at hand.
KEEP_WORDS, KEEP_BYTES = 300_000, 32 << 20


class Vocabulary:
    """Tokens as bytes and the merges of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        self.splitter = Splitter(path)
        raw, model = self.splitter.bytes_of, self.splitter.spec["model"]
        if any(model.get(k) for k in ("ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("models that ignore merges, fall back to bytes, or mark parts of words aren't known")
        decode = lambda s: bytes(raw[c] for c in s)
        self.id = {decode(t): i for t, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.id[decode(a)], self.id[decode(b)]): (k, self.id[decode(a) + decode(b)]) for k, (a, b) in enumerate(merges)}
        n = max([*self.id.values(), *self.splitter.special.values()]) + 1
        self.token = [b""] * n
        for t, i in self.id.items():
            self.token[i] = t
        for t, i in self.splitter.special.items():
            self.token[i] = t.encode()
        self.longest = max(map(len, self.id))
        self.size = [len(t) for t in self.token]
        self._whole: dict[int, bool] = {}
        self._pair: dict[int, bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """Encoding by the merges themselves, for pairs of tokens."""
        ids = [self.id[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 60, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def whole(self, t: int) -> bool:
        """Whether the token's bytes encode to the token."""
        if (known := self._whole.get(t)) is None:
            known = self._whole[t] = self.merged(self.token[t]) == [t]
        return known

    def goes(self, a: int, b: int) -> bool:
        """Whether b may follow a in an encoding."""
        key = a << 32 | b
        if (known := self._pair.get(key)) is None:
            if len(self._pair) > 1_000_000:
                self._pair.clear()
            known = self._pair[key] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return known

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of sorted distinct words: one depth-first walk over their trie."""
        ids, size, longest, goes, whole = self.id, self.size, self.longest, self.goes, self.whole
        last = [-1]  # the last token at each depth of the current path
        before, out = b"", []
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                for n in range(min(depth, longest), 0, -1):
                    t = ids.get(word[depth - n : depth])
                    if t is not None and (goes(last[depth - n], t) if depth > n else whole(t)):
                        last.append(t)
                        break
                else:
                    raise ValueError(f"no encoding of {word!r}")
            own, depth = [], len(word)
            while depth:
                own.append(last[depth])
                depth -= size[last[depth]]
            out.append(own[::-1])
            before = word
        return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; encodings of words are kept between texts."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        splitter = self.vocabulary.splitter
        parts = [[s if isinstance(s, int) else splitter.split(s) for s in splitter.segments(t)] if t else [] for t in texts]
        if len(self.known) > KEEP_WORDS or self.held > KEEP_BYTES:
            self.known.clear()
            self.held = 0
        known, new = self.known, set()
        for part in parts:
            for p in part:
                if not isinstance(p, int):
                    new.update(p)
        new -= known.keys()
        self.held += 2 * sum(map(len, new))
        by_bytes = sorted((w.encode(), w) for w in new)
        for (_, w), ids in zip(by_bytes, self.vocabulary.encode([b for b, _ in by_bytes]), strict=True):
            known[w] = np.array(ids, "<u4").tobytes()
        return [b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(known.__getitem__, p)) for p in part]) for part in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a worker, whichever task asks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _run(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for s in C.slices(batch.column("text")):
                part = batch.slice(s.first, s.n)
                ids = own.encode(part.column("text").to_pylist())
                back = list(map(own.decode, ids))
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, sha(ids), sha(x.encode() for x in back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    width = pa.list_(pa.int32())
                    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                    at = np.zeros(s.n + 1, np.int32)
                    np.cumsum([len(x) // 4 for x in ids], out=at[1:])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), flat).cast(width), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])
        own.known.clear()
        C.release()

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: the ids of each text and the text that they decode to."""
    return C.text_of(docs).mapInArrow(_run(path, digests=False), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text's ids and of the text that they decode to."""
    return C.text_of(docs).mapInArrow(_run(path, digests=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
