"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the windows of ``size`` consecutive words of each benchmark item (an item of fewer words is
one window).  The alphabet of the search is the word: blocks are of up to three words, the shift table says how far
no test string can end, a shift of 0 opens the bucket of test strings with that suffix block, in which the place's own
words select one by their hash, and these are compared directly.  Equal windows are one test string with a list of items,
and equal lists are one list, so a place has one candidate and a document gets each list once, however many items share
a window.  Documents are scanned in lanes of bounded length that advance together, each by its own shifts.
The tables of a block of items are made once, by the driver, and broadcast as arrays.  With several blocks the texts are
written once; each block then reads them and writes only what it finds, which is merged by document at last.

Defined cases: a null text has no words and no hits; an item without id or without words has no windows; the same
item_id in several rows joins their windows; repeated documents each give a row, as does one with a null doc_id; a very
long text is searched whole; without documents there are no rows, without items no hits; other columns aren't looked at,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LANE = 256
#: Benchmark text that is held as one broadcast set of test strings; a larger benchmark is searched in such blocks.  The
#: tables of a block take about 20 times its bytes at the most, and the shift table 16 MB.
BLOCK_BYTES, SHIFT_BITS = 8 << 20, 24
#: Words that are compared directly at once, and items in a batch of results.
PAIRS, ITEMS = 1 << 17, 1 << 20


class _Tables:
    """Shift table and suffix buckets of distinct test strings with m words, which begin at the words ``first`` of a text."""

    def __init__(self, m: int, first: np.ndarray, hashes: np.ndarray) -> None:
        self.m, self.b = m, min(3, m)
        bits = min(SHIFT_BITS, max(16, int(np.ceil(np.log2(16 * len(first) * (m - self.b + 1) + 1)))))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, min(127, m - self.b + 1), np.int8)
        for end in range(self.b, m + 1):
            np.minimum.at(self.shift, (self.block(hashes, first + end - 1) >> self.down).astype(np.int64), np.int8(min(127, m - end)))
        suffix, whole = self.block(hashes, first + m - 1), self.block(hashes, first + m - 1, m)
        self.order = np.lexsort((suffix, whole))
        self.suffixes, self.whole, self.first = np.unique(suffix), whole[self.order], first[self.order]

    def block(self, hashes: np.ndarray, end: np.ndarray, b: int | None = None) -> np.ndarray:
        """Hash of the block of b words that ends at each position."""
        b = b or self.b
        with np.errstate(over="ignore"):
            x = np.full(len(end), b, np.uint64)
            for i in range(b - 1, -1, -1):
                x = (x ^ hashes[end - i]) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(32)
        return x

    def scan(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words at which a window may begin, and the test strings of their buckets with an equal hash: one for each
        place, but for collisions."""
        length = np.maximum(0, last - first - self.m + 1)
        pieces = -(-length // LANE)
        at = C.ragged(np.zeros(len(first), np.int64), pieces) * LANE + np.repeat(first + self.m - 1, pieces)
        stop = np.minimum(at + LANE, np.repeat(last, pieces))
        found = [np.zeros(0, np.int64)]
        while len(at):
            step = self.shift[(self.block(hashes, at) >> self.down).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        ends = np.concatenate(found)
        suffix = self.block(hashes, ends)
        ends = ends[self.suffixes[np.minimum(np.searchsorted(self.suffixes, suffix), len(self.suffixes) - 1)] == suffix]
        whole = self.block(hashes, ends, self.m)
        low, high = np.searchsorted(self.whole, whole, "left"), np.searchsorted(self.whole, whole, "right")
        return np.repeat(ends, high - low) - self.m + 1, C.ragged(low, high - low)


def _distinct_lists(owner: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of each of n owners' list of items, and the distinct lists (sorted numbers of items)."""
    pairs = np.unique(np.stack([owner, item]), axis=1)
    cuts = np.searchsorted(pairs[0], np.arange(n + 1))
    known: dict[bytes, int] = {}
    lists: list[np.ndarray] = []
    of = np.zeros(n, np.int64)
    for k, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        own = pairs[1, a:z]
        of[k] = known.setdefault(own.tobytes(), len(lists))
        if of[k] == len(lists):
            lists.append(own)
    return of, lists


class Matcher:
    """All test strings of a block of items, (item id as text, text) pairs: their words and the tables.

    Items are numbered in the order of their ids; ``names`` has the ids."""

    def __init__(self, items: list[tuple[str, str | None]], size: int) -> None:
        items = sorted((i, t) for i, t in items if i is not None and t)
        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.data = C.lower_table()[np.frombuffer(b"".join(raw), np.uint8)]
        self.words = C.words(self.data, offsets, C.alnum_words())
        item = np.array([number[i] for i, _ in items], np.int64)
        have = np.bincount(self.words.doc, minlength=len(items))
        begin = np.cumsum(have) - have
        self.tables, self.of_window, self.lists = [], [], []
        for m in np.unique(np.minimum(have[have > 0], size)).tolist():
            own = np.flatnonzero(np.minimum(have, size) == m)
            first = C.ragged(begin[own], have[own] - m + 1)
            window, first = self._distinct(m, first)
            table = _Tables(m, first[0], self.words.hash)
            of, lists = _distinct_lists(window, item[self.words.doc[first[1]]], len(first[0]))
            self.tables.append(table)
            self.of_window.append(of[table.order])
            self.lists.append(lists)

    def _distinct(self, m: int, first: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The number of each window's test string; the first words of the test strings and of the windows, in that order."""
        hashes = C.rolling(self.words.hash, m)[first]
        order = np.argsort(hashes, kind="stable")
        first, hashes = first[order], hashes[order]
        new = np.ones(len(first), bool)
        near = np.flatnonzero(hashes[1:] == hashes[:-1])
        for part in np.array_split(near, len(near) * m // PAIRS + 1):
            new[part + 1] = ~self._equal(m, self.data, self.words, first[part + 1], first[part])
        return np.cumsum(new) - 1, (first[new], first)

    def _equal(self, m: int, data: np.ndarray, w: C.Words, a: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether the m words from a on are the m words of the items from p on, compared directly."""
        x, y = (a[:, None] + np.arange(m)).ravel(), (p[:, None] + np.arange(m)).ravel()
        n = w.end[x] - w.start[x]
        same = n == self.words.end[y] - self.words.start[y]
        i = np.flatnonzero(same)
        if len(i):
            n = n[i]
            differ = data[C.ragged(w.start[x[i]], n)] != self.data[C.ragged(self.words.start[y[i]], n)]
            same[i] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        return same.reshape(-1, m).all(axis=1)

    def find(self, data: np.ndarray, w: C.Words, offsets: np.ndarray, hit: np.ndarray) -> list[list[tuple[int, int]]]:
        """Marks the words inside occurrences in hit; returns the lists (of a table) that each document has, each once."""
        n = len(offsets) - 1
        first = np.searchsorted(w.doc, np.arange(n), "left")
        last = np.searchsorted(w.doc, np.arange(n), "right")
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for t, (table, of) in enumerate(zip(self.tables, self.of_window, strict=True)):
            at, pattern = table.scan(w.hash, first, last)
            for part in np.array_split(np.arange(len(at)), max(1, len(at) * table.m // PAIRS)):
                a, p = at[part], pattern[part]
                sure = self._equal(table.m, data, w, a, table.first[p])
                a, p = a[sure], p[sure]
                hit[(a[:, None] + np.arange(table.m)).ravel()] = True
                for doc, k in np.unique(np.stack([w.doc[a], of[p]]), axis=1).T.tolist():
                    found[doc].append((t, k))
        return [list(dict.fromkeys(x)) for x in found]

    def items(self, found: list[tuple[int, int]]) -> np.ndarray:
        """Numbers of the items of some lists, in order."""
        if len(found) == 1:
            return self.lists[found[0][0]][found[0][1]]
        have = np.zeros(len(self.names), bool)
        for t, k in found:
            have[self.lists[t][k]] = True
        return np.flatnonzero(have)


def _searched(batch: pa.RecordBatch, matcher: Matcher) -> Iterator[tuple[C.Slice, np.ndarray, np.ndarray, list]]:
    """Slices of a batch's texts with the edges of documents among words, the words that are hit, and lists found."""
    low, inside = C.lower_table(), C.alnum_words()
    for s in C.slices(batch.column("text")):
        data = low[s.data]
        w = C.words(data, s.offsets, inside)
        edges = np.concatenate([[0], np.cumsum(np.bincount(w.doc, minlength=s.n))])
        hit = np.zeros(len(w.doc), bool)
        yield s, edges, hit, matcher.find(data, w, s.offsets, hit)


def _bits(hit: np.ndarray, a: int, z: int) -> bytes:
    return np.packbits(hit[a:z]).tobytes() if hit[a:z].any() else bytes(-(-(z - a) // 8))


def _pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have at most ITEMS items together, or one row."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > ITEMS:
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def _pass(matcher_of):
    """All documents with what a block of items finds in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of.value
        for batch in batches:
            for s, edges, hit, found in _searched(batch, matcher):
                for i, j in _pieces([sum(len(matcher.lists[t][k]) for t, k in x) for x in found]):
                    part = batch.slice(s.first + i, j - i)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            part.column("text"),
                            pa.array(np.diff(edges[i : j + 1]), pa.int64()),
                            pa.array([_bits(hit, a, z) for a, z in zip(edges[i:j].tolist(), edges[i + 1 : j + 1].tolist(), strict=True)], pa.binary()),
                            pa.array([[matcher.names[x] for x in matcher.items(f).tolist()] for f in found[i:j]], pa.list_(pa.string())),
                        ],
                        ["doc_id", "text", "n_words", "hits", "items"],
                    )
        C.release()

    return run


def _finds(matcher_of):
    """row, hits, items of the documents in which a block of items finds anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of.value
        for batch in batches:
            for s, edges, hit, found in _searched(batch, matcher):
                for i in (k for k, x in enumerate(found) if x):
                    names = [matcher.names[x] for x in matcher.items(found[i]).tolist()]
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(s.first + i, 1), pa.array([_bits(hit, edges[i], edges[i + 1])]), pa.array([names], pa.list_(pa.string()))], ["row", "hits", "items"])
        C.release()

    return run


def _either(t: pa.Table) -> pa.Table:
    """One row's finds of all blocks as one."""
    bits = np.zeros(len(t.column("hits")[0].as_py()), np.uint8)
    for x in t.column("hits").to_pylist():
        bits |= np.frombuffer(x, np.uint8)
    names = sorted({x for some in t.column("items").to_pylist() for x in some})
    return pa.Table.from_arrays([t.column("row").combine_chunks()[:1], pa.array([bits.tobytes()]), pa.array([names], pa.list_(pa.string()))], ["row", "hits", "items"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words of each document, before its finds are known."""
    low, inside = C.lower_table(), C.alnum_words()
    for batch in batches:
        n = [np.bincount(C.spans(inside[low[s.data]], s.offsets)[2], minlength=s.n) for s in C.slices(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64())], [*batch.schema.names, "n_words"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = b.column("items").to_pylist()
        n_hit = [int.from_bytes(x, "little").bit_count() for x in b.column("hits").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("n_words"),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]),
                pa.array([x > 0 for x in n_hit]),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The stated test set in blocks of bounded size: its bytes are counted first, and one block is fetched at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // most))
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r[0], r[1]) for r in own.collect()]


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, text, n_words, hits (a bit for each word, most significant first), items (sorted ids) of each document."""
    spark, texts = docs.sparkSession, C.text_of(docs)
    rows, finds, sent = None, [], None
    for items in item_blocks(benchmark):
        if sent is not None and rows is None:  # a second block
            rows = C.stored(texts.mapInArrow(_counted, "doc_id long, text string, n_words long").withColumn("row", F.monotonically_increasing_id()), "decontam")
            finds.append(sent)
        sent = spark.sparkContext.broadcast(Matcher(items, size))
        if rows is not None:
            finds.append(sent)
    if rows is None:
        return texts.mapInArrow(_pass(sent), "doc_id long, text string, n_words long, hits binary, items array<string>")
    found = None
    for sent in finds:
        own = C.stored(rows.select("row", "text").mapInArrow(_finds(sent), "row long, hits binary, items array<string>"), "decontam-finds")
        sent.unpersist()
        found = own if found is None else found.unionByName(own)
    found = C.stored(found.groupBy("row").applyInArrow(_either, "row long, hits binary, items array<string>"), "decontam-found")
    none = F.unhex(F.repeat(F.lit("00"), F.ceil(F.col("n_words") / 8).cast("int")))
    out = rows.join(found, "row", "left")
    return out.select("doc_id", "text", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each document."""
    return matches(docs, benchmark, size).select("doc_id", "n_words", "hits", "items").mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark occurs; rows with a null doc_id are kept or
    dropped by their own text like any other."""
    spark = docs.sparkSession
    out = C.beside(docs, text=F.col("text").cast("string"))
    for items in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(Matcher(items, size))

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for s, _, _, found in _searched(batch, sent.value):
                    keep[s.first : s.first + s.n] = [not x for x in found]
                yield batch.filter(pa.array(keep))
            C.release()

        out = out.mapInArrow(clean, out.schema)
    return C.rows_of(out, docs.columns)
