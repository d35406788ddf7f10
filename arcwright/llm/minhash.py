"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and union-find.

A document's set is its distinct shingles of ``size`` words.  Each shingle draws a random permutation of the registers
and ranks k + r_k along it; a register keeps the least rank that meets it.  Ranks of step k lie in [k, k + 1), so a
document stops at the step after which no register is empty: steps run over all documents of a slice at once.

Documents with one and the same set are one class, represented by its least doc_id.  Classes that agree on all rows
of a band are candidates, gathered as star edges (never as pairs); connected candidates form clusters.  A cluster is
verified on full sets by rows of intersection sizes: of any pair that the cluster's largest component doesn't hold
already, one row is computed.  Clusters of more than ``block`` classes are dealt to many tasks (``_large_clusters``).

Shingles are told apart by 128 bits, mixed one to one from their words: 64 of them draw the registers, and sets are
counted, compared and intersected on all 128.

Defined cases: a document without words has an empty set and links with nothing; one of fewer words than ``size`` has
its whole sequence as one shingle; a very long text is one document like any other; rows with one doc_id are one node;
a null doc_id links with nothing and is kept; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected, join_heavy

#: Bands of rows; at a similarity of 0.8 a linked pair agrees on no band with a probability under 1e-4, at 0.85 of 1e-6.
BANDS, ROWS = 24, 5
#: Classes of a cluster that one task verifies.
BLOCK = 128
EMPTY = np.iinfo(np.uint64).max
#: Bytes of band keys and ids that one task links, as planned.
SHARD_BYTES = 64 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, as two lanes of hashes sorted by the first within each document, and the documents' edges; data
    is lower-cased."""
    n = len(offsets) - 1
    w = C.words(data, offsets, C.space_words())
    first = np.concatenate([[0], np.cumsum(np.bincount(w.doc, minlength=n))])
    have = np.diff(first)
    count = np.maximum(have - size + 1, 0)
    short = np.flatnonzero((have > 0) & (have < size))
    edges = np.concatenate([[0], np.cumsum(count + ((have > 0) & (have < size)))])
    full, source = C.ragged(edges[:-1], count), C.ragged(first[:-1], count)
    both = []
    for lane, h in enumerate((w.hash, C.range_hashes(data, w.start, w.end, 1))):
        out = np.zeros(edges[-1], np.uint64)
        out[full] = C.rolling(h, size, lane)[source]
        for i in short.tolist():
            out[edges[i]] = C.rolling(h[first[i] : first[i + 1]], int(have[i]), lane)[0]
        both.append(out)
    order = np.arange(len(both[0]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            order[a:b] = a + np.argsort(both[0][a:b], kind="stable")
    owner = np.repeat(np.arange(n), np.diff(edges))
    one, two = both[0][order], both[1][order]
    if ((one[1:] == one[:-1]) & (two[1:] != two[:-1]) & (owner[1:] == owner[:-1])).any():
        order = np.lexsort([both[1], both[0], owner])
        one, two = both[0][order], both[1][order]
    new = C.new_of(one, two)
    new[1:] |= owner[1:] != owner[:-1]
    return one[new], two[new], np.concatenate([[0], np.cumsum(new)])[edges]


def numbered(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct elements of two lanes, and how often each occurs."""
    order = C.order_of(one, two)
    new = C.new_of(one[order], two[order])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, np.diff(np.append(np.flatnonzero(new), len(order)))


def signatures(elements: np.ndarray, edges: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash registers (documents by m); those of an empty set stay EMPTY."""
    n = len(edges) - 1
    out = np.full(n * m, EMPTY, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(edges))
    e, order, k = elements, None, 0
    while len(e) and k < m:
        with np.errstate(over="ignore"):
            drawn = C.mix(e + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
            rank = np.uint64(k << 56) | (C.mix(drawn) >> np.uint64(8))
        other = k + ((drawn >> np.uint64(33)) % np.uint64(m - k)).astype(np.int64)
        if order is None:
            place = other
        else:
            row = np.arange(len(e))
            place = order[row, other].astype(np.int64)
            order[row, other] = order[:, k]
        np.minimum.at(out, doc * m + place, rank)
        empty = (out.reshape(n, m) == EMPTY).any(axis=1)
        going = empty[doc]
        if order is None:
            e, doc, other = e[going], doc[going], other[going]
            order = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
            order[np.arange(len(e)), other] = 0
        else:
            e, doc, order = e[going], doc[going], order[going]
        k += 1
    return out.reshape(n, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each document."""
    with np.errstate(over="ignore"):
        x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(registers), bands)).copy()
        for i in range(rows):
            x = C.mix((x ^ registers[:, i : bands * rows : rows]) * np.uint64(0xD1342543DE82EF95))
    return x


def _sets(size: int, bands: int, rows: int):
    """Documents to n_shingles, digest of the set and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = C.lower_table()
        for batch in batches:
            for s in C.slices(batch.column("text")):
                one, two, edges = shingles(low[s.data], s.offsets, size)
                keys = band_keys(signatures(one, edges, bands * rows), bands, rows)
                raw = np.stack([one, two], axis=1).tobytes()
                digest = [hashlib.blake2b(raw[16 * a : 16 * b], digest_size=16).digest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.n), pa.array(np.diff(edges)), pa.array(digest, pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )
        C.release()

    return run


def _stars(groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by (group, id): positions of the groups' first rows, and edges of the others to them."""
    first = C.starts_of(groups)
    to = np.repeat(ids[first], np.diff(np.concatenate([first, [len(ids)]])))
    return first, ids, to


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = a != b
    if not own.any():
        return a[:0], b[:0]
    a, b = np.unique(np.stack([a[own], b[own]]), axis=1)
    return a, b


def candidate_edges(classes: DataFrame) -> DataFrame:
    """a, b: star edges between classes (rep, bands) that share a band key.

    A task links its own classes key by key and sends each key once, in one packed row for each shard of keys; a shard
    links what the tasks sent.  A hot key costs each task a single entry.  Shards grow in number with the classes.
    """
    size = classes.agg(F.sum(F.octet_length("bands"))).first()[0] or 0
    shards = max(C.tasks(classes.sparkSession), -(-2 * int(size) // SHARD_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint64)
            ids = np.repeat(batch.column("rep").to_numpy(), len(keys) // batch.num_rows)
            order = np.lexsort([ids, keys])
            keys, ids = keys[order], ids[order]
            first, a, b = _stars(keys, ids)
            a, b = _distinct(a, b)
            keys, ids = keys[first], ids[first]
            shard = (keys >> np.uint64(33)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            packed = [(np.concatenate([keys[o], ids[o].view(np.uint64)]).tobytes() if len(o := order[cut[k] : cut[k + 1]]) else None) for k in range(shards)]
            rows = [(k, p, None) for k, p in enumerate(packed) if p] + ([(int(a[0]) % shards, None, np.stack([a, b]).tobytes())] if len(a) else [])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "keys", "links"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for k, e in zip(batch.column("keys").to_pylist(), batch.column("links").to_pylist(), strict=True):
                if k is not None:
                    x = np.frombuffer(k, np.uint64)
                    keys.append(x[: len(x) // 2])
                    ids.append(x[len(x) // 2 :].view(np.int64))
                else:
                    x = np.frombuffer(e, np.int64)
                    a.append(x[: len(x) // 2])
                    b.append(x[len(x) // 2 :])
        k, i = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort([i, k])
        _, x, y = _stars(k[order], i[order])
        x, y = _distinct(np.concatenate([x, *a]), np.concatenate([y, *b]))
        for j in range(0, len(x), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[j : j + (1 << 16)]), pa.array(y[j : j + (1 << 16)])], ["a", "b"])

    sent = classes.select("rep", "bands").mapInArrow(send, "shard long, keys binary, links binary")
    return sent.repartition(shards, "shard").mapInArrow(link, "a long, b long")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component of each set (two lanes of distinct elements), as the least position in it: pairs with
    100 * intersection >= percent * union link."""
    k = len(sets)
    size = np.array([s.shape[1] for s in sets])
    parent = np.arange(k)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)

    inverse, df = numbered(*np.concatenate(sets, axis=1))
    if k == 2:
        both = int((df > 1).sum())
        if 100 * both >= percent * (size.sum() - both):
            join(0, 1)
        return parent
    edges = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(k), size)
    live = np.ones(k, bool)
    while True:  # a set of which too few elements occur in any other links with nothing
        shared = np.bincount(owner, weights=df[inverse] > 1, minlength=k)
        gone = live & (100 * shared < percent * size)
        if not gone.any():
            break
        live &= ~gone
        df = df - np.bincount(inverse[gone[owner]], minlength=len(df))
    central = np.bincount(owner, weights=df[inverse], minlength=k) / np.maximum(size, 1)
    mark = np.zeros(len(df), np.int64)
    largest = -1
    for i in sorted(np.flatnonzero(live).tolist(), key=lambda i: -central[i]):
        if largest >= 0 and root(i) == root(largest):
            continue
        own = inverse[edges[i] : edges[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[inverse], edges[:-1])
        mark[own] = 0
        hits = np.flatnonzero(100 * both >= percent * (size[i] + size - both))
        for j in hits.tolist():
            join(i, j)
        if largest < 0:
            largest = i
    return np.array([root(i) for i in range(k)])


def _by_key(size: int, per_key, names: list[str]):
    """Rows (key, cluster, doc_id, text) sorted by key: per_key(cluster, ids, sets) gives the columns of what it finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = C.lower_table()
        key, cluster, ids, sets = None, None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                found = per_key(cluster, np.array(ids, np.int64), sets)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)

        for batch in batches:
            for s in C.slices(batch.column("text")):
                part = batch.slice(s.first, s.n)
                one, two, edges = shingles(low[s.data], s.offsets, size)
                own = np.split(np.stack([one, two]), edges[1:-1], axis=1)
                for k, c, i, x in zip(part.column("key").to_pylist(), part.column("cluster").to_pylist(), part.column("doc_id").to_pylist(), own, strict=True):
                    if k != key:
                        yield from done()
                        key, cluster, ids, sets = k, c, [], []
                    ids.append(i)
                    sets.append(x)
        yield from done()
        C.release()

    return run


def _edges(percent: int):
    def found(_, ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        labels = linked(sets, percent)
        own = labels != np.arange(len(ids))
        return ids[own], ids[labels[own]]

    return found


def _most_central(cluster: int, ids: np.ndarray, sets: list[np.ndarray]) -> tuple[list, ...]:
    """The set whose elements occur in most others, by their mean number."""
    inverse, df = numbered(*np.concatenate(sets, axis=1))
    size = np.array([s.shape[1] for s in sets])
    mean = np.add.reduceat(df[inverse], np.cumsum(size) - size) / size
    i = int(np.argmax(mean))
    return [cluster], [int(ids[i])], [float(mean[i])]


def _dealt(members: DataFrame, run, schema: str) -> DataFrame:
    return members.repartition(C.tasks(members.sparkSession), "key").sortWithinPartitions("key", "doc_id").mapInArrow(run, schema)


def _large_clusters(full: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """Edges of clusters (cluster, members, doc_id, text) beyond a block, each dealt to many tasks.

    1. Chunks of a cluster are verified within, and each names its most central set; the most central of all is the hub.
    2. Chunks are verified with the hub among them: most of a dense cluster then is one component with its hub.
    3. What isn't linked with the hub then is verified, in blocks, against all chunks.
    Each pair of a cluster meets in 1 or 3, or both are linked with the hub.
    """
    chunks = F.ceil(F.col("members") / F.lit(max(1, block // 2))).cast("int")
    full = full.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    total = full.count()
    keyed = lambda df, *more: df.select(F.concat_ws("-", "cluster", "chunk", *more).alias("key"), "cluster", "doc_id", "text")
    edge, link = _by_key(size, _edges(percent), ["a", "b"]), "a long, b long"
    inner = _dealt(keyed(full), edge, link)
    central = _dealt(keyed(full), _by_key(size, _most_central, ["cluster", "hub", "mean"]), "cluster long, hub long, mean double")
    hubs = C.stored(central.groupBy("cluster").agg(F.max_by("hub", F.struct("mean", "hub")).alias("hub")), "minhash-hubs")
    hub = full.join(hubs.select(F.col("hub").alias("doc_id")), "doc_id", "left_semi").select("cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc_id", "text")
    first = C.stored(inner.unionByName(_dealt(keyed(full.select("cluster", "chunk", "doc_id", "text").unionByName(hub)), edge, link)), "minhash-hub-links")
    component = C.stored(connected(first, "minhash-hub-components"), "minhash-hub-components")
    sizes = component.groupBy("component").agg(F.count("*").alias("n"))
    of_hub = hubs.join(component, F.col("hub") == F.col("id")).select("component").distinct().join(sizes, "component")
    linked_ids = join_heavy(component, of_hub, "component", total).select(F.col("id").alias("doc_id"))
    rest = C.stored(full.join(linked_ids, "doc_id", "left_anti"), "minhash-rest")
    blocks = F.ceil(F.count("*") / F.lit(max(1, block // 2))).cast("int").alias("blocks")
    left = C.stored(rest.groupBy("cluster").agg(blocks, F.max("members").alias("n")), "minhash-rest-sizes")
    mine = join_heavy(rest, left, "cluster", total).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")).cast("int"))
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> chunk").withColumn("chunk", F.col("other"))
    theirs = join_heavy(full, left, "cluster", total).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a document of the rest that is in the chunk itself: in its block's job once, by ``theirs``
    both = keyed(mine, "block").unionByName(keyed(theirs, "block"))
    return first.unionByName(_dealt(both, edge, link))


def groups(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each document."""
    texts = C.text_of(docs)
    sets = C.stored(texts.mapInArrow(_sets(size, bands, rows), "doc_id long, n_shingles long, digest binary, bands binary"), "minhash-sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = C.stored(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("n")), "minhash-classes")
    clusters = C.stored(connected(candidate_edges(classes), "minhash-candidates"), "minhash-clusters")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members")).withColumn("n", F.col("members"))
    sized = join_heavy(clusters, sizes, "component", clusters.count()).withColumnRenamed("component", "cluster")
    texts = texts.where("doc_id is not null").hint("merge")  # texts are dealt once, and at any size: neither side's is bounded
    members = C.stored(sized.join(texts, sized.id == F.col("doc_id")).select("cluster", "members", "doc_id", "text"), "minhash-members")
    small = members.where(F.col("members") <= block).select(F.col("cluster").cast("string").alias("key"), "cluster", "doc_id", "text")
    found = _dealt(small, _by_key(size, _edges(percent), ["a", "b"]), "a long, b long")
    found = found.unionByName(_large_clusters(members.where(F.col("members") > block), size, percent, block))
    components = connected(found, "minhash-links")
    of = C.stored(classes.select("digest", "rep", "n").join(components, F.col("rep") == F.col("id"), "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id")), "minhash-groups")
    placed = join_heavy(full.select("doc_id", "n_shingles", "digest"), of, "digest", full.count(), "left").select("doc_id", "n_shingles", "component_id")
    alone = sets.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those of documents that aren't the least doc_id of their group.

    Rows that share one doc_id stay or go together; rows without doc_id stay.
    """
    gone = groups(docs, size, percent).where("not kept").select("doc_id").distinct()
    kept = C.beside(docs, doc_id=F.col("doc_id").cast("long")).join(gone, "doc_id", "left_anti")
    return C.rows_of(kept, docs.columns)
