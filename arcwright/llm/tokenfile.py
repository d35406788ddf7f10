"""Token-id output: flat unsigned integer files with 64-bit document offsets, read back by memory mapping.

Format of a dataset folder, all little-endian, one set of files per partition of the doc_id range, in order:
``part-NNNNNN.tokens`` ids, uint16 if every id of the vocabulary fits, else uint32;
``part-NNNNNN.docs``   int64 doc_id of each document, 0 for those without one;
``part-NNNNNN.nulls``  int64, how many of its first documents have no doc_id;
``part-NNNNNN.offsets`` uint64, one more than documents: where each begins in the whole dataset, counted in ids.

Documents are dealt by ranges of doc_id and sorted within them; tasks write their files under a temporary name and
move them when complete, so a task can be run again anywhere.  Each task's number of ids goes to the driver (a row for
each partition); prefix sums of these are the partitions' bases.  A second pass writes the offsets and reads all back.

Defined cases: a null or empty text is a document of the end id alone; documents with one doc_id follow each other in
the order of their texts, and their ranges are cut by the texts' beginnings too; documents without doc_id come first;
a very long text is one document like any other; an empty table gives a dataset without files and no rows; other columns aren't looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import nullcontext
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .splitting import Splitter, byte_characters

#: Words, and bytes of words, whose ids an encoder keeps at most, beside those of the texts at hand.
KEEP_WORDS, KEEP_BYTES = 300_000, 32 << 20
#: Documents, and ids beyond the first document's, that are read back at once.
READ_DOCS, READ_IDS = 4096, 4 << 20
#: Characters of a text by which rows of one doc_id are dealt.
BEGINS = 64


class LibraryEncoder:
    """Ids by the tokenizers library, which encodes each distinct word once."""

    def __init__(self, path: str) -> None:
        self.splitter = Splitter(path)
        self.model, self.chars = self.splitter.tokenizer.model, byte_characters()
        self.n = max([*self.splitter.spec["model"]["vocab"].values(), *self.splitter.special.values()]) + 1
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _word(self, word: str) -> bytes:
        mapped = "".join(map(self.chars.__getitem__, word.encode()))
        return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > KEEP_WORDS or self.held > KEEP_BYTES:
            self.known.clear()
            self.held = 0
        known, split, out = self.known, self.splitter.split, []
        for text in texts:
            parts = []
            for s in self.splitter.segments(text or ""):
                if isinstance(s, int):
                    parts.append(s.to_bytes(4, "little"))
                    continue
                found = split(s)
                for w in set(found).difference(known):
                    known[w] = self._word(w)
                    self.held += 2 * len(w)
                parts.append(b"".join(map(known.__getitem__, found)))
            out.append(b"".join(parts))
        return out


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


class Dataset(NamedTuple):
    """A written dataset: its folder, bytes of an id, and of each partition the number, documents, ids and base."""

    folder: str
    width: int
    parts: list[tuple[int, int, int, int]]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(uri: str, name: str, data: np.ndarray) -> None:
    fs, folder = _place(uri)
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(np.ascontiguousarray(data).tobytes())
    fs.move(temporary, f"{folder}/{name}")


def _get(uri: str, name: str, kind: str) -> np.ndarray:
    """The file as an array: mapped into memory where the store is a file system, else read."""
    fs, folder = _place(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        size = fs.get_file_info(f"{folder}/{name}").size
        return np.memmap(f"{folder}/{name}", dtype=kind, mode="r") if size else np.zeros(0, kind)
    with fs.open_input_file(f"{folder}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def _ranges(uri: str, name: str, kind: str, edges: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, ids) of ranges of documents whose ids lie between edges; only a range is in memory at a time."""
    fs, folder = _place(uri)
    local, step = isinstance(fs, pafs.LocalFileSystem), np.dtype(kind).itemsize
    with nullcontext() if local else fs.open_input_file(f"{folder}/{name}") as f:
        mapped, first = _get(uri, name, kind) if local else None, 0
        while first < len(edges) - 1:
            last = int(np.searchsorted(edges, edges[first] + READ_IDS, "right")) - 1
            last = min(max(last, first + 1), first + READ_DOCS, len(edges) - 1)
            a, b = int(edges[first]), int(edges[last])
            yield first, last, mapped[a:b] if f is None else np.frombuffer(f.read_at((b - a) * step, a * step), kind)
            first = last


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> Dataset:
    """Encodes the texts, each followed by end_id, and writes them in ascending order of doc_id."""
    spark = docs.sparkSession
    folder = folder or C.fresh_path(spark, "tokens")
    fs, path = _place(folder)
    fs.create_dir(path, recursive=True)
    width = 2 if LibraryEncoder(tokenizer).n <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = encoder(tokenizer), TaskContext.get().partitionId()
        fs, path = _place(folder)
        end, name = end_id.to_bytes(4, "little"), f"part-{k:06d}"
        temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
        ids, lengths, nulls = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        with fs.open_output_stream(temporary) as f:
            for batch in batches:
                ids.append(batch.column("doc_id").fill_null(0).to_numpy())
                nulls += batch.column("doc_id").null_count
                for s in C.slices(batch.column("text")):
                    blobs = own.encode(batch.column("text").slice(s.first, s.n).to_pylist())
                    lengths.append(np.array([len(b) // 4 + 1 for b in blobs], np.int64))
                    f.write(np.frombuffer(end.join([*blobs, b""]), "<u4").astype(f"<u{width}").tobytes())
        n = np.concatenate(lengths)
        if len(n):
            fs.move(temporary, f"{path}/{name}.tokens")
            _put(folder, f"{name}.docs", np.concatenate(ids).astype("<i8"))
            _put(folder, f"{name}.nulls", np.array([nulls], "<i8"))  # they sort first
            _put(folder, f"{name}.lengths", n.astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["part", "n_docs", "n_tokens"])
        else:
            fs.delete_file(temporary)

    begins = F.substring("text", 1, BEGINS)
    dealt = C.text_of(docs).repartitionByRange(C.tasks(spark), F.col("doc_id"), begins).sortWithinPartitions("doc_id", "text")
    rows = sorted(tuple(r) for r in dealt.mapInArrow(run, "part long, n_docs long, n_tokens long").collect())
    bases = np.concatenate([[0], np.cumsum([r[2] for r in rows])]).tolist() if rows else [0]
    return Dataset(folder, width, [(*r, b) for r, b in zip(rows, bases, strict=False)])


def read_back(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """Writes the offsets and returns doc_id, start, n_tokens, ids_crc32 of each document as the files have them."""
    folder, kind = dataset.folder, f"<u{dataset.width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                name = f"part-{part:06d}"
                lengths = _get(folder, f"{name}.lengths", "<i8")
                offsets = np.zeros(len(lengths) + 1, "<u8")
                np.cumsum(lengths, out=offsets[1:])
                _put(folder, f"{name}.offsets", offsets + np.uint64(base))
                nulls = int(_get(folder, f"{name}.nulls", "<i8")[0])
                docs, offsets = _get(folder, f"{name}.docs", "<i8"), _get(folder, f"{name}.offsets", "<u8").astype(np.int64)
                for i, j, tokens in _ranges(folder, f"{name}.tokens", kind, offsets - base):
                    at = offsets[i : j + 1]
                    edges = (at - at[0]).tolist()
                    crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    own = docs[i:j].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=np.arange(i, j) < nulls), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = spark.createDataFrame([(p, b) for p, _, _, b in dataset.parts], "part long, base long").repartition(max(1, min(len(dataset.parts), C.tasks(spark))))
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the dataset to the shared folder and returns what the files hold, a row for each document."""
    return read_back(docs.sparkSession, write(docs, tokenizer, end_id))
