"""Removal of byte strings that occur in an earlier document, by suffix arrays of shards.

Removed is each byte covered by a string of ``size`` bytes that also starts in a document with a smaller doc_id.

1. Documents are dealt to buckets by a hash of doc_id.  A bucket sends each of its distinct anchors (``anchors``) once,
   packed, to the shard of the anchor's hash.  A shard tells buckets which anchors more than one document has, and to
   which home such an anchor's strings go: a hash of the set of buckets that have it, so that all anchors of a passage
   go to one home; the hash of the anchor where more than ``SPREAD`` buckets have it.
2. A bucket cuts the runs of strings whose anchors are shared and have one home, and sends each distinct run once, with
   the least document that has it.  A home lays its distinct runs side by side, builds a suffix array by induced sorting,
   and finds the equal strings in its permuted common prefixes.  More than ``ARRAY_BYTES`` are dealt by anchors
   to several arrays.
3. Buckets get the spans that their documents lose.  Of a run that an earlier document has as a whole, that is all.

All occurrences of a string have one anchor, hence one home.  Equal runs are compared by their bytes.  The three steps
read one and the same exchange of the texts.  A passage in a third of all documents is an entry for each bucket, not for
each document.  The number of packed rows grows no faster than the input (``common.buckets``).

Defined cases: a null text counts as empty; texts under ``size`` bytes lose nothing; a very long text is one text like
any other; rows with one doc_id don't remove from each other; a row with a null doc_id neither loses nor removes anything;
an empty table gives no rows; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import common as C
from .suffixes import repeats

#: Bytes of runs in a suffix array, as planned.
ARRAY_BYTES = 4 << 20
#: Buckets with an anchor beyond which its strings go to a home of its own.
SPREAD = 16
OWN_HOME = np.uint32(0xFFFFFFFF)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """From all bits of a hash."""
    return (C.mix(h) % np.uint64(shards)).astype(np.int64)


def _texts(table: pa.Table) -> Iterator[tuple[C.Slice, np.ndarray, np.ndarray]]:
    """Slices of a bucket's texts with their doc_ids and row numbers.  Rows are numbered by doc_id, then text, so that
    the numbers are the same whenever the bucket is read."""
    ids, number = table.column("id").to_numpy(), np.empty(table.num_rows, np.int64)
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    if same.any():
        text = table.column("text")
        twice = set(ids[order][1:][same].tolist())
        order = np.array(sorted(order.tolist(), key=lambda i: (int(ids[i]), (text[i].as_py() or "") if int(ids[i]) in twice else "")), np.int64)
    number[order] = np.arange(len(order))
    at = 0
    for chunk in table.column("text").chunks:
        for s in C.slices(chunk):
            own = slice(at + s.first, at + s.first + s.n)
            yield s, ids[own], number[own]
        at += len(chunk)


def _by(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, and starts and ends of its runs."""
    order = np.argsort(key, kind="stable")
    first = C.starts_of(key[order])
    return order, first, np.append(first[1:], len(key)) if len(key) else first


def _packed(to: np.ndarray, pack) -> list[tuple]:
    """(destination, *pack(entries)) for each destination."""
    order, first, end = _by(to)
    return [(int(to[order[a]]), *pack(order[a:z])) for a, z in zip(first.tolist(), end.tolist(), strict=True)]


def _table(rows: list[tuple], keys: list[str], payloads: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * (len(keys) + len(payloads))
    types = [pa.int64()] * len(keys) + [pa.binary()] * len(payloads)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[*keys, *payloads])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _send_anchors(size: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s, ids, _ in _texts(table):
            pos, h = A.anchors(s.data, s.offsets, size)
            hashes.append(h)
            docs.append(ids[np.searchsorted(s.offsets, pos, "right") - 1])
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order, first, _ = _by(h)
        h, d = h[order], d[order]
        many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(h) else np.zeros(0, bool)
        h, b = h[first], table.column("b")[0].as_py()
        return _table(_packed(_shard(h, shards), lambda o: (b, C.six(h[o]), np.packbits(many[o]).tobytes())), ["shard", "b"], ["anchors", "many"])

    return run


def _shared_anchors(shards: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [C.of_six(x) for x in table.column("anchors").to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)) for m, p in zip(table.column("many").to_pylist(), parts, strict=True)])
        h, b = np.concatenate(parts), table.column("b").to_numpy()
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order, first, end = _by(h)
        with np.errstate(over="ignore"):
            holders = np.add.reduceat(C.mix(b.view(np.uint64) + np.uint64(1))[row[order]], first)
        n = end - first
        home = np.where(n == 1, b[row[order[first]]], _shard(holders, shards)).astype(np.uint32)
        home[n > SPREAD] = OWN_HOME
        shared = (n > 1) | (np.maximum.reduceat(many[order], first) > 0)
        keep = order[np.repeat(shared, n)]
        home = np.repeat(home[shared], n[shared])
        return _table(_packed(b[row[keep]], lambda o: (C.six(h[keep[o]]), home[o].tobytes())), ["b"], ["anchors", "home"])

    return run


class _Runs:
    """Runs of bytes laid side by side, with the document, its row and the place there of each."""

    def __init__(self, doc: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray, data: np.ndarray) -> None:
        self.doc, self.row, self.at, self.n, self.data = doc, row, at, n, data
        self.start = np.cumsum(n) - n

    def bytes_of(self, some: np.ndarray) -> np.ndarray:
        return self.data[C.ragged(self.start[some], self.n[some])]

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Order by class of equal bytes, then document, and whether each in that order begins a class."""
        h = C.range_hashes(self.data, self.start, self.start + self.n)
        order = np.lexsort([self.at, self.row, self.doc, self.n, h])
        new = np.ones(len(order), bool)
        a, b = order[:-1], order[1:]
        alike = np.flatnonzero((h[a] == h[b]) & (self.n[a] == self.n[b]))
        for part in np.array_split(alike, max(1, int(self.n[a[alike]].sum()) >> 22)):
            if len(part):
                n = self.n[a[part]]
                differ = self.bytes_of(a[part]) != self.bytes_of(b[part])
                new[1 + part] = np.logical_or.reduceat(differ, np.cumsum(n) - n)
        return order, new


def _cut(s: C.Slice, size: int, known: np.ndarray, home_of: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
    """Runs of a slice: home, document of the slice, start and end."""
    h, doc, low, high = A.strings(s.data, s.offsets, size)
    key = h & np.uint64((1 << 48) - 1)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    own = np.flatnonzero(known[at] == key)
    home, spread = home_of[at[own]].astype(np.int64), home_of[at[own]] == OWN_HOME
    home[spread] = _shard(key[own[spread]] ^ np.uint64(1), shards)
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1] + 1) | (doc[own[1:]] != doc[own[:-1]]) | (home[1:] != home[:-1]) | spread[1:] | spread[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1 if len(own) else first
    return home[first], doc[own[first]], low[own[first]], high[own[last]] + size


def _spans(row: np.ndarray, a: np.ndarray, z: np.ndarray) -> bytes:
    """Row, start and end of spans, those of a row that meet joined."""
    if not len(row):
        return b""
    order = np.lexsort([a, row])
    row, a, z = row[order], a[order], z[order]
    base = row * (int(z.max()) + 1)
    reach = np.maximum.accumulate(z + base)
    new = np.concatenate([[True], (a + base)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([row[first], a[first], np.maximum.reduceat(z, first)]).astype(np.uint32).tobytes()


def _of_spans(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros((3, 0), np.uint32), *(np.frombuffer(p, np.uint32).reshape(3, -1) for p in parts if p)], axis=1).astype(np.int64)


RUNS = ["doc", "row", "at", "n", "data", "spans"]


def _send_runs(size: int, shards: int):
    """Rows for homes: distinct runs with their least documents, and of a run that this document has again only where
    (n is 0).  What the bucket itself knows, the spans of its other documents, goes with them, to the home of its number."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return _table([], ["home", "b"], RUNS)
        b = told.column("b")[0].as_py()
        known, home_of = np.concatenate([C.of_six(x) for x in told.column("anchors").to_pylist()]), _joined(told.column("home"), np.uint32)
        order = np.argsort(known)
        known, home_of = known[order], home_of[order]
        parts = []
        for s, ids, number in _texts(table):
            home, doc, a, z = _cut(s, size, known, home_of, shards)
            parts.append((home, ids[doc], number[doc], a - s.offsets[doc], z - a, s.data[C.ragged(a, z - a)]))
        home, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        r = _Runs(*rest)
        order, new = r.classes()
        number = np.cumsum(new) - 1
        head = order[new]
        least = r.doc[head][number]
        earlier = r.doc[order] != least  # an earlier document of the bucket has the whole run
        gone = order[earlier]
        sends, again = order[~earlier], ~new[~earlier]
        n = np.where(again, 0, r.n[sends])

        def pack(o: np.ndarray) -> tuple:
            i = sends[o]
            return b, r.doc[i].tobytes(), r.row[i].astype(np.uint32).tobytes(), r.at[i].astype(np.uint32).tobytes(), n[o].astype(np.uint32).tobytes(), r.bytes_of(i[n[o] > 0]).tobytes(), b""

        rows = _packed(home[sends], pack)
        if spans := _spans(r.row[gone], r.at[gone], r.at[gone] + r.n[gone]):
            rows.append((b, b, b"", b"", b"", b"", b"", spans))
        return _table(rows, ["home", "b"], RUNS)

    return run


def _equal_strings(r: _Runs, size: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of equal strings of the runs (group, run, start), by one suffix array, or by several to which strings are
    dealt by their anchors."""
    total = len(r.data)
    if total <= most:
        yield repeats(r.data, size, np.append(r.start, total))
        return
    arrays = -(-total // most)
    h, run, low, high = A.strings(r.data, np.append(r.start, total), size)
    piece = (C.mix(h ^ np.uint64(1)) % np.uint64(arrays)).astype(np.int64)
    for k in range(arrays):
        own = np.flatnonzero(piece == k)
        if not len(own):
            continue
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1] + 1) | (run[own[1:]] != run[own[:-1]])
        first = np.flatnonzero(new)
        a, z = low[own[first]], high[own[np.append(first[1:], len(own)) - 1]] + size
        group, window, start = repeats(r.data[C.ragged(a, z - a)], size, np.concatenate([[0], np.cumsum(z - a)]))
        of = run[own[first]][window]
        yield group, of, a[window] + start - r.start[of]


def _match_runs(size: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        row_of = np.repeat(np.arange(table.num_rows), [len(x) // 8 for x in table.column("doc").to_pylist()])
        doc, row, at, n = _joined(table.column("doc"), np.int64), *(_joined(table.column(c), np.uint32).astype(np.int64) for c in ("row", "at", "n"))
        out: dict[int, list[bytes]] = {}
        bs = table.column("b").to_pylist()
        for b, spans in zip(bs, table.column("spans").to_pylist(), strict=True):
            if spans:
                out.setdefault(b, []).append(spans)
        if len(doc):
            full = np.flatnonzero(n > 0)
            of = np.cumsum(n > 0) - 1  # an entry without bytes is the run before it, in another place of the document
            r = _Runs(doc[full], row[full], at[full], n[full], _joined(table.column("data"), np.uint8))
            order, new = r.classes()
            kind = np.empty(len(order), np.int64)
            kind[order] = np.cumsum(new) - 1
            head = order[new]
            one = _Runs(r.doc[head], r.row[head], r.at[head], r.n[head], r.bytes_of(head))
            marked_class, marked_start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for group, which, start in _equal_strings(one, size, most):
                if len(group):
                    first = C.starts_of(group)
                    smallest = np.repeat(np.minimum.reduceat(one.doc[which], first), np.diff(np.append(first, len(group))))
                    earlier = smallest < one.doc[which]
                    marked_class.append(which[earlier])
                    marked_start.append(start[earlier])
            c, a = np.concatenate(marked_class), np.concatenate(marked_start)
            lost = _of_spans([_spans(c, a, a + size)])  # of each class, in its first document
            edge = np.searchsorted(lost[0], np.arange(len(head) + 1))
            c = kind[of]
            whole = np.flatnonzero(doc > one.doc[c])
            part = np.flatnonzero(doc == one.doc[c])
            each = edge[c[part] + 1] - edge[c[part]]
            i, part = C.ragged(edge[c[part]], each), np.repeat(part, each)
            entry = np.concatenate([whole, part])
            start = np.concatenate([at[whole], at[part] + lost[1][i]])
            stop = np.concatenate([at[whole] + one.n[c[whole]], at[part] + lost[2][i]])
            b_of = np.array(bs, np.int64)[row_of[entry]]
            for b, spans in _packed(b_of, lambda o: (_spans(row[entry[o]], start[o], stop[o]),)):
                out.setdefault(b, []).append(spans)
        return _table([(b, x) for b, xs in out.items() for x in xs], ["b"], ["spans"])

    return run


def _marked(table: pa.Table, told: pa.Table) -> Iterator[tuple[C.Slice, np.ndarray]]:
    """Slices of a bucket with a mask of the bytes that go."""
    row, a, z = _of_spans(told.column("spans").to_pylist())
    order = np.argsort(row, kind="stable")
    row, a, z = row[order], a[order], z[order]
    for s, _, number in _texts(table):
        low, high = np.searchsorted(row, number, "left"), np.searchsorted(row, number, "right")
        i, base = C.ragged(low, high - low), np.repeat(s.offsets[:-1], high - low)
        depth = np.bincount(a[i] + base, minlength=len(s.data) + 1) - np.bincount(z[i] + base, minlength=len(s.data) + 1)
        yield s, np.cumsum(depth)[: len(s.data)] > 0


def _digest(table: pa.Table, told: pa.Table) -> pa.Table:
    n_removed, n_spans, sha, n_bytes = [], [], [], []
    for s, gone in _marked(table, told):
        start, end, doc = C.spans(gone, s.offsets)
        n_spans += np.bincount(doc, minlength=s.n).tolist()
        n_removed += np.bincount(doc, weights=end - start, minlength=s.n).astype(np.int64).tolist()
        n_bytes += np.diff(s.offsets).tolist()
        sha += [hashlib.sha256(s.data[a:z][~gone[a:z]].tobytes()).hexdigest() for a, z in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
    return pa.table({"doc_id": table.column("id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def _rewrite(table: pa.Table, told: pa.Table) -> pa.Table:
    """Rows with the text that is left; a span that would split a character begins or ends at the next one inside."""
    texts = []
    for s, gone in _marked(table, told):
        inner = (s.data & 0xC0) == 0x80  # not the first byte of a character
        start, end, _ = C.spans(gone, s.offsets)
        keep = ~gone
        for a, z in zip(start.tolist(), end.tolist(), strict=True):
            while a < z and inner[a]:
                keep[a] = True
                a += 1
            while z > a and z < len(inner) and inner[z]:
                z -= 1
                keep[z] = True
        texts += [s.data[a:z][keep[a:z]].tobytes().decode() for a, z in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
    was = table.column("text").is_valid().to_pylist()
    return pa.table({"row": table.column("row"), "text": pa.array([t if v else None for t, v in zip(texts, was, strict=True)], pa.string())})


def _freed(run):
    """run, after which the worker's freed memory goes back."""

    def one(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        C.release()
        return out

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        return one(a, b)

    def single(a: pa.Table) -> pa.Table:
        return one(a)

    return two if len(inspect.signature(run).parameters) == 2 else single


def _answers(dealt: DataFrame, size: int, shards: int, most: int) -> DataFrame:
    """Spans that buckets' documents lose (b, spans), from documents dealt to buckets (b, id, text; other columns
    travel with them, so that all steps read one exchange)."""
    anchors = dealt.groupBy("b").applyInArrow(_freed(_send_anchors(size, shards)), "shard long, b long, anchors binary, many binary")
    shared = anchors.groupBy("shard").applyInArrow(_shared_anchors(shards), "b long, anchors binary, home binary")
    sent = dealt.groupBy("b").cogroup(shared.groupBy("b")).applyInArrow(_freed(_send_runs(size, shards)), "home long, b long, doc binary, row binary, at binary, n binary, data binary, spans binary")
    return sent.groupBy("home").applyInArrow(_freed(_match_runs(size, most)), "b long, spans binary")


def _dealt(docs: DataFrame, more: list) -> tuple[DataFrame, int]:
    """b, id, text and the columns ``more`` of rows with a doc_id, and the number of buckets."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    size = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    parts = C.buckets(spark, size, entry=14)  # bytes from one anchor to the next, about, at the usual size
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), *more)
    return own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts).cast("long"))), parts


def removals(docs: DataFrame, size: int = 50, most: int = ARRAY_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each document."""
    docs = docs.select("doc_id", "text")
    dealt, shards = _dealt(docs, [])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = dealt.groupBy("b").cogroup(_answers(dealt, size, shards, most).groupBy("b")).applyInArrow(_freed(_digest), schema)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.lit(0).cast("long")
    alone = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return found.unionByName(alone)


def remove(docs: DataFrame, size: int = 50, most: int = ARRAY_BYTES) -> DataFrame:
    """The rows of docs, all columns, with what is left of their texts."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    row = F.struct(*(F.col(f"`{n}`") for n in docs.columns if n != "text")).alias("row")
    dealt, shards = _dealt(docs, [row])
    kind = dealt.select("row", "text").schema
    found = dealt.groupBy("b").cogroup(_answers(dealt, size, shards, most).groupBy("b")).applyInArrow(_freed(_rewrite), kind)
    placed = found.select(*(F.col("text") if n == "text" else F.col("row").getField(n).alias(n) for n in docs.columns))
    return placed.unionByName(docs.where("doc_id is null"))
