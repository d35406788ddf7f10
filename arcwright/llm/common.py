"""Shared pieces of the operators: vectorised tokenising of Arrow text, hashing and tables in the shared folder.

Texts reach Python as Arrow batches.  A batch is cut into slices of a bounded number of bytes, and each
slice is handled as one byte array with document offsets, so that work per word is a numpy operation.
A document longer than the bound forms a slice of its own: texts are always processed whole.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, fresh_path, stored  # noqa: F401

SLICE_BYTES = 2 << 20

U64 = np.uint64
#: Bytes of a range beyond which it is hashed on its own.
LONG = 512
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_C1, _C2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def lower_table() -> np.ndarray:
    """Byte to byte: A-Z to a-z, all else unchanged."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_words() -> np.ndarray:
    """True for the bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_words() -> np.ndarray:
    """True for the bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased text."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


class Slice(NamedTuple):
    """Rows ``first`` to ``first + n`` of a batch: document i is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column in slices of at most ``most`` bytes, or of one longer document."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield Slice(i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * _C1
        x = x ^ (x >> U64(27))
        x = x * _C2
        return x ^ (x >> U64(31))


class Words(NamedTuple):
    """Words of a slice in order: byte ranges, document of the slice, 64-bit hash (of lane 0)."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the maximal runs of True, none of which crosses a document's edge."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words of bytes: ``inside`` says which byte values belong to words.  data is lower-cased already."""
    start, end, doc = spans(inside[data], offsets)
    return Words(start, end, doc, range_hashes(data, start, end))


def wide(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a little-endian number; the last seven positions have none."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), 0, (1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time, each mixed in turn; long ranges by blake2b.

    Each step is one to one and none is linear, so no kind of text collides by its form.  Hashes of two lanes make one
    of 128 bits."""
    length = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = wide(padded)
    with np.errstate(over="ignore"):
        out = mix(length.astype(U64) * _GOLD + U64(lane) * _C2)
        live = np.flatnonzero((length > 0) & (length <= LONG))
        at, left, h = start[live], length[live], out[live]
        while len(live):
            h = mix((h ^ (words[at] & _MASKS[np.minimum(left, 8)])) * (_C2 if lane else _GOLD))
            done = left <= 8
            if done.any():
                out[live[done]] = h[done]
                live, at, left, h = live[~done], at[~done], left[~done], h[~done]
            at, left = at + 8, left - 8
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()[8 * lane : 8 * lane + 8], "little")
    return out


def rolling(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of each n consecutive entries, len(hashes) - n + 1 of them."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        x = np.full(k, U64(n * 1_000_003 + salt))
        for i in range(n):
            x = (x ^ hashes[i : i + k]) * _C2
            x ^= x >> U64(29)
        return mix(x)


def order_of(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Order of hashes of two lanes, in which equal ones follow each other.  The second lane is compared only where the
    first one collides, that is hardly ever."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    return np.lexsort([two, one]) if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else order


def new_of(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """True where an element of two lanes, ordered, differs from the one before."""
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return new


LOW48 = U64((1 << 48) - 1)


def six(h: np.ndarray) -> bytes:
    """The low six bytes of each hash, for what a shard of them needn't tell apart for certain."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def of_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def starts_of(groups: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal values in a sorted or grouped array."""
    if not len(groups):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1])


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[i] .. start[i] + length[i]."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def text_of(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the key and the text, under names of our own, so that other columns can't clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))


def beside(df: DataFrame, **own) -> DataFrame:
    """Columns of our own beside the rows packed in the struct ``row``: whatever their names, they can't clash."""
    return df.select(*(c.alias(n) for n, c in own.items()), F.struct(*(F.col(f"`{n}`") for n in df.columns)).alias("row"))


def rows_of(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that ``beside`` packed."""
    return df.select(*(F.col("row").getField(n).alias(n) for n in names))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of text that a bucket holds at least, and entries of a packed row from a bucket to a shard.
BUCKET_BYTES, ENTRIES = 8 << 20, 64


def buckets(spark: SparkSession, size: int, entry: int, least: int = BUCKET_BYTES) -> int:
    """Number of buckets, and of shards that they send to, for so many bytes of text, of which there is an entry to be
    sent in about every ``entry`` bytes.  Packed rows from all buckets to all shards hold at least ENTRIES entries on the
    average: buckets grow with the square root of a very large input, and rows never outgrow it."""
    return max(tasks(spark), -(-size // max(least, int((size * entry * ENTRIES) ** 0.5))))


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def release() -> None:
    """Memory that a worker has freed goes back to the system: workers outlive their tasks, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
