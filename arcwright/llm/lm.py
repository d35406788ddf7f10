"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts.

1. Partitions of the training texts count words and bigrams (pairs of consecutive tokens; a text follows an end token)
   and send each distinct one once, packed, to the shard of its hash.  A shard adds the counts up.
2. A count c of a bigram is quantised to the level q = 1 + floor(log2 c), and the keys (bigram, 1) .. (bigram, q) are
   put into the shard's slice of the Bloom filter, whose bits are planned from the number of keys: the filter grows
   with the corpus.  Up to ``FILTER_BYTES`` it is broadcast: written as one file, given to every machine as a Spark
   file, and mapped into memory there.  A larger one stays with its shards, which answer what they are asked.
3. Documents are dealt to buckets.  A bucket asks for the exact count of each of its distinct words once, so that a very
   common word is an entry for each bucket and not for each document; and for the levels of its distinct bigrams, where
   the filter isn't broadcast.  Levels come from repeated membership probes: (bigram, 1), (bigram, 2), .. until one fails.
4. A token's probability after the token h is w * min(1, C / c(h)) + (1 - w) * p1, with C the mean count of the training
   bigrams of the level, and p1 = (c + 1) / (N + V + 1); where c(h) is 0, it is p1.  The weight w depends on the
   magnitude of c(h).  It is chosen of WEIGHTS by the likelihood of all training tokens, each with its own occurrence
   taken out of the counts.

As C is the mean of its level, the estimates of a context add up to 1 on the average over contexts, not in each: a filter
can't list the bigrams of a context.  False positives of the filter (about 1 in 85 probes) can raise a level; levels are
never too low.  Words are told apart by 128 bits, mixed one to one from their bytes; a shard of the filter tells its
bigrams apart by 48.

Defined cases: a null text counts as empty, whose only token is the end; a very long text is one text like any other; a
row without doc_id isn't held out and is learned from; with no training text, N and V are 0 and scores are those of the
base; repeated rows are learned from and scored each; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text in a bucket at least, of grams held before they are sent, and of a filter that is broadcast, at most.
BUCKET_BYTES, FLUSH_BYTES, FILTER_BYTES = 8 << 20, 64 << 20, 256 << 20
#: Bits of the filter for each key, and probes for each membership test.
BITS, PROBES = 10, 4
#: Weights of the bigram estimate to choose from, and the least c(h) of each magnitude after the first.
WEIGHTS = np.array([0.001, 0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97])
MAGNITUDES = np.array([2, 4, 16, 64, 256, 4096, 65536])
#: More levels than a 64-bit count has.
LEVELS = 64
END = np.array([0x6A09E667F3BCC909, 0xBB67AE8584CAA73B], np.uint64)
NONE = np.zeros(0, np.uint64)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (C.mix(h) % np.uint64(shards)).astype(np.int64)


def tokens(s: C.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a slice in two lanes (2, n), an end after each text, and offsets of the texts among them."""
    data = C.lower_table()[s.data]
    w = C.words(data, s.offsets, C.space_words())
    counts = np.bincount(w.doc, minlength=s.n)
    edges = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.repeat(END[:, None], edges[-1], axis=1)
    at = np.arange(len(w.doc)) + w.doc
    out[0, at], out[1, at] = w.hash, C.range_hashes(data, w.start, w.end, 1)
    return out, edges


def bigrams(t: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it, an end before the first of a text; of the first lane of both."""
    with np.errstate(over="ignore"):
        before = np.concatenate([END[:1], t[0, :-1]]) if t.shape[1] else t[0]
        return C.mix(C.mix(before * np.uint64(0x9E3779B97F4A7C15)) ^ t[0])


def _added(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of some lanes (lanes, n), in order, and the sums of their counts."""
    order = np.argsort(h[0], kind="stable") if len(h) == 1 else C.order_of(*h)
    h, n = h[:, order], n[order]
    start = np.flatnonzero(C.new_of(h[0], h[-1]))
    return h[:, start], np.add.reduceat(n, start) if len(start) else n[:0]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _added(h, np.ones(h.shape[1], np.int64))


def _packed(h: np.ndarray, n: np.ndarray, shards: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Shard, hashes and counts: first the hashes with counts over 1, in the order of those counts, then the others."""
    shard = _shard(h[0], shards)
    order = np.lexsort((n == 1, shard))
    h, n, shard = h[:, order], n[order], shard[order]
    start = C.starts_of(shard)
    for a, z in zip(start.tolist(), [*start[1:].tolist(), len(n)], strict=True) if len(n) else ():
        yield int(shard[a]), _raw(h[:, a:z]), n[a:z][n[a:z] > 1].astype(np.int64).tobytes()


def _raw(h: np.ndarray) -> bytes:
    """Words (two lanes) in full, bigrams by six bytes."""
    return h.T.tobytes() if len(h) == 2 else C.six(h[0])


def _of_raw(lanes: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64).reshape(-1, 2).T if lanes == 2 else C.of_six(raw)[None]


def _unpacked(lanes: int, h: list[bytes], n: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = [np.zeros((lanes, 0), np.uint64)], [np.zeros(0, np.int64)]
    for a, b in zip(h, n, strict=True):
        hashes.append(_of_raw(lanes, a))
        own = np.ones(hashes[-1].shape[1], np.int64)
        more = np.frombuffer(b, np.int64)
        own[: len(more)] = more
        counts.append(own)
    return _added(np.concatenate(hashes, axis=1), np.concatenate(counts))


def _grams(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                if parts:
                    for shard, a, b in _packed(*_added(np.concatenate([h for h, _ in parts], axis=1), np.concatenate([n for _, n in parts])), shards):
                        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([kind], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], ["shard", "kind", "h", "n"])
                    parts.clear()

        for batch in batches:
            for s in C.slices(batch.column("text")):
                t, _ = tokens(s)
                for parts, own in zip(held, (t, bigrams(t)[None]), strict=True):
                    parts.append(_distinct(own))
                    size += parts[-1][0].nbytes + parts[-1][1].nbytes
                if size > FLUSH_BYTES:
                    yield from sent()
                    size = 0
        yield from sent()
        C.release()

    return run


def levels(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2 n) of counts of 1 and more."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def _positions(h: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """Places of the key (h, level) in a filter of so many bits, one array for each probe."""
    with np.errstate(over="ignore"):
        x = C.mix(h + np.asarray(level).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        step = (x >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield ((x + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * np.asarray(bits).astype(np.uint64) >> np.uint64(32)


def bloom(h: np.ndarray, n: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bytes of the log-frequency filter of hashes with counts; under 2 ** 32 bits, which a shard's share never needs."""
    level = levels(n)
    size = 8 * max(8, -(-int(level.sum()) * bits // 8))
    marked = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in _positions(h[level >= q], q, size):
            marked[at.astype(np.int64)] = True
    return np.packbits(marked, bitorder="little")


def probe(h: np.ndarray, data: np.ndarray, base: np.ndarray | int, bits: np.ndarray | int) -> np.ndarray:
    """Levels of hashes (0: not in the filter): keys of level 1, 2, .. are probed until one isn't there.  Each hash has
    its slice of ``bits`` bits that begins at the byte ``base``."""
    base, bits = np.broadcast_to(base, len(h)), np.broadcast_to(bits, len(h))
    level, left, q = np.zeros(len(h), np.int64), np.flatnonzero(bits > 0), 1
    while len(left):
        held = np.ones(len(left), bool)
        for at in _positions(h[left], q, bits[left]):
            at = at.astype(np.int64)
            held &= (data[base[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0
        left = left[held]
        level[left] = q
        q += 1
    return level


class Filter:
    """The whole filter as a file that every machine has: offsets of the shards' slices in bytes."""

    def __init__(self, name: str, edges: np.ndarray) -> None:
        self.name, self.edges = name, edges

    def levels(self, h: np.ndarray, shard: np.ndarray) -> np.ndarray:
        if not self.edges[-1]:
            return np.zeros(len(h), np.int64)
        data = np.memmap(SparkFiles.get(self.name), np.uint8, "r")
        return probe(h, data, self.edges[shard], 8 * (self.edges[shard + 1] - self.edges[shard]))


COUNTED = "shard long, words binary, n binary, filter binary, size long, total long, distinct long, level_n array<long>, level_sum array<long>"


def _count(bits: int):
    """A shard's words with counts and slice of the filter, and by level the number of its bigrams and the sum of their counts."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        (h, n), (g, m) = (_unpacked(2 - kind, *(table.take(np.flatnonzero(kinds == kind)).column(c).to_pylist() for c in ("h", "n"))) for kind in (0, 1))
        level, kept = levels(m), bloom(g[0], m, bits).tobytes() if len(m) else b""
        by = np.bincount(level, minlength=LEVELS).tolist(), np.bincount(level, weights=m, minlength=LEVELS).astype(np.int64).tolist()
        row = [table.column("shard")[0].as_py(), h.T.tobytes(), n.tobytes(), kept, len(kept), int(n.sum()), len(n), *by]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        C.release()
        return pa.table([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in COUNTED.split(", ")])

    return run


def _own_tokens(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, tokens and offsets of each slice of a bucket."""
    first = 0
    for chunk in table.column("text").chunks:
        for s in C.slices(chunk):
            yield first + s.first, *tokens(s)
        first += len(chunk)


def _numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of some lanes, in order, and for each hash the number of its own."""
    order = np.argsort(h[0], kind="stable") if len(h) == 1 else C.order_of(*h)
    new = C.new_of(h[0][order], h[-1][order])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return h[:, order[new]], number


def _by_shard(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by shard in which a bucket asks and is told, and the shards in it."""
    shard = _shard(h[0], shards)
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def _ask(shards: int, asks_levels: bool):
    def run(table: pa.Table) -> pa.Table:
        words, grams = [END[:, None]], [NONE[None]]
        for _, t, _ in _own_tokens(table):
            words.append(_distinct(t)[0])
            if asks_levels:
                grams.append(_distinct(bigrams(t)[None])[0])
        asked: dict[int, list[bytes]] = {}
        for k, h in enumerate((words, grams)):
            h = _distinct(np.concatenate(h, axis=1))[0]
            order, shard = _by_shard(h, shards)
            start = C.starts_of(shard)
            for a, z in zip(start.tolist(), [*start[1:].tolist(), len(shard)] if len(start) else [], strict=True):
                asked.setdefault(int(shard[a]), [b"", b""])[k] = _raw(h[:, order[a:z]])
        b = table.column("b")[0].as_py()
        return pa.table([pa.array(list(asked), pa.int64()), pa.array([b] * len(asked), pa.int64()), *(pa.array([x[k] for x in asked.values()], pa.binary()) for k in (0, 1))], names=["shard", "b", "words", "grams"])

    return run


def _looked_up(known: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Counts of words (two lanes) among the known ones, which are in order; 0 where there is none."""
    if not known.shape[1] or not h.shape[1]:
        return np.zeros(h.shape[1], np.int64)
    i, last = np.searchsorted(known[0], h[0]), known.shape[1] - 1
    while True:
        j = np.minimum(i, last)
        other = (known[0, j] == h[0]) & (known[1, j] != h[1]) & (i <= last)
        if not other.any():
            return np.where((known[0, j] == h[0]) & (known[1, j] == h[1]) & (i <= last), n[j], 0)
        i = i + other


def _tell(asked: pa.Table, counted: pa.Table) -> pa.Table:
    known, n, kept = np.zeros((2, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    if counted.num_rows:
        known, n = np.ascontiguousarray(_of_raw(2, counted.column("words")[0].as_py())), np.frombuffer(counted.column("n")[0].as_py(), np.int64)
        kept = np.frombuffer(counted.column("filter")[0].as_py(), np.uint8)
    out, level = [], []
    for words, grams in zip(asked.column("words").to_pylist(), asked.column("grams").to_pylist(), strict=True):
        out.append(_looked_up(known, n, _of_raw(2, words)).tobytes())
        level.append(probe(C.of_six(grams), kept, 0, 8 * len(kept)).astype(np.uint8).tobytes())
    return pa.table([asked.column("b"), asked.column("shard"), pa.array(out, pa.binary()), pa.array(level, pa.binary())], names=["b", "shard", "n", "level"])


def _log_sums(group: np.ndarray, groups: int, magnitude: np.ndarray, share: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """For each group, magnitude and weight, the sum of log10 of the mixture: groups x (magnitudes * weights)."""
    m = len(MAGNITUDES) + 1
    cell = group * m + magnitude
    out = [np.bincount(cell, weights=np.log10(w * share + (1 - w) * p1), minlength=groups * m) for w in WEIGHTS]
    return np.stack(out, axis=1).reshape(groups, m * len(WEIGHTS))


def _score(shards: int, total: int, distinct: int, mean: np.ndarray, filter_: Filter | None):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        own_tokens = list(_own_tokens(table))
        order = np.argsort(told.column("shard").to_numpy(), kind="stable").tolist()
        answer = lambda c, kind: np.frombuffer(b"".join(x[i] for i in order), kind) if (x := told.column(c).to_pylist()) else np.zeros(0, kind)
        h, word_of = _numbered(np.concatenate([END[:, None], *(t for _, t, _ in own_tokens)], axis=1))
        of_word = np.empty(h.shape[1], np.int64)
        of_word[_by_shard(h, shards)[0]] = answer("n", np.int64)
        pairs, pair_of = _numbered(np.concatenate([NONE, *(bigrams(t) for _, t, _ in own_tokens)])[None])
        level_of = np.empty(pairs.shape[1], np.int64)
        order_, shard = _by_shard(pairs, shards)
        level_of[order_] = filter_.levels(pairs[0, order_] & C.LOW48, shard) if filter_ else answer("level", np.uint8)
        trains = table.column("trains").to_numpy(zero_copy_only=False)
        n_tokens, n_known, base, fixed, sums, kept_out = [], [], [], [], [], []
        end_count, done = of_word[word_of[0]], 0
        for first, t, edges in own_tokens:
            n, doc = len(edges) - 1, np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            c = of_word[word_of[done + 1 : done + 1 + t.shape[1]]]
            before = np.concatenate([[end_count], c[:-1]]) if len(c) else c
            p1 = (c + 1) / (total + distinct + 1)
            count = mean[level_of[pair_of[done : done + t.shape[1]]]]
            done += t.shape[1]
            log1 = np.log10(p1)
            seen = before > 0
            n_tokens += np.diff(edges).tolist()
            n_known += np.bincount(doc, weights=c > 0, minlength=n).astype(np.int64).tolist()
            base += np.bincount(doc, weights=log1, minlength=n).tolist()
            fixed += np.bincount(doc, weights=np.where(seen, 0.0, log1), minlength=n).tolist()
            magnitude = np.searchsorted(MAGNITUDES, before, "right")
            share = np.minimum(1.0, count / np.maximum(before, 1))
            sums.append(_log_sums(doc[seen], n, magnitude[seen], share[seen], p1[seen]))
            own = (before > 1) & trains[first + doc]
            left = before[own] - 1
            share = np.minimum(1.0, np.maximum(count[own] - 1, 0) / left)
            kept_out.append(_log_sums(np.zeros(int(own.sum()), np.int64), 1, np.searchsorted(MAGNITUDES, left, "right"), share, p1[own]))
        width = (len(MAGNITUDES) + 1) * len(WEIGHTS)
        sums_ = np.concatenate([np.zeros((0, width)), *sums])
        # the bucket's held-out-of-itself sums go with its first row
        fit = np.sum(kept_out, axis=0)[0].tolist() if kept_out else []
        C.release()
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "base_score": pa.array(base, pa.float64()), "fixed": pa.array(fixed, pa.float64()), "sums": lists(sums_), "fit": pa.array([fit if i == 0 else None for i in range(len(sums_))], pa.list_(pa.float64())),
        })

    return run


def model(docs: DataFrame, shards: int, bits: int = BITS) -> DataFrame:
    """A row for each shard of the texts in docs: COUNTED."""
    grams = docs.select("text").mapInArrow(_grams(shards), "shard long, kind int, h binary, n binary")
    return C.stored(grams.groupBy("shard").applyInArrow(_count(bits), COUNTED), "lm-counts")


def broadcast(counted: DataFrame, shards: int) -> Filter:
    """The filter as a file for every machine; the driver holds a slice at a time."""
    spark, sizes = counted.sparkSession, np.zeros(shards, np.int64)
    path = C.fresh_path(spark, "lm-filter")
    fs, place = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(place) as f:
        for r in counted.where("size > 0").select("shard", "filter").orderBy("shard").toLocalIterator():
            sizes[r.shard] = len(r.filter)
            f.write(bytes(r.filter))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    if edges[-1]:
        spark.sparkContext.addFile(path)
    return Filter(path.rsplit("/", 1)[1], edges)


def scores(docs: DataFrame, held_out: str, most: int = FILTER_BYTES, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document; rows for which ``held_out``
    holds aren't learned from.  A filter of up to ``most`` bytes is broadcast; results don't depend on whether it is."""
    spark = docs.sparkSession
    texts = C.text_of(docs).withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    size = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = C.buckets(spark, size, entry=14, least=BUCKET_BYTES)
    counted = model(texts.where("not held_out"), parts, bits)
    by = [F.coalesce(F.sum(F.col(c)[q]), F.lit(0)).alias(f"{c}{q}") for c in ("level_n", "level_sum") for q in range(LEVELS)]
    total, distinct, bytes_, *by_level = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "size")), *by).first()
    mean = np.array(by_level[LEVELS:], float) / np.maximum(1, by_level[:LEVELS])
    empty = mean == 0
    mean[empty] = 2.0 ** (np.arange(LEVELS)[empty] - 1)  # levels that only false positives reach
    mean[0] = 0.0
    filter_ = broadcast(counted, parts) if bytes_ <= most else None

    dealt = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts).cast("long")).alias("b"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out", (~F.col("held_out")).alias("trains"))
    asked = dealt.groupBy("b").applyInArrow(_ask(parts, filter_ is None), "shard long, b long, words binary, grams binary")
    kept = F.col("filter") if filter_ is None else F.lit(b"").alias("filter")
    told = asked.groupBy("shard").cogroup(counted.select("shard", "words", "n", kept).groupBy("shard")).applyInArrow(_tell, "b long, shard long, n binary, level binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, fixed double, sums array<double>, fit array<double>"
    scored = C.stored(dealt.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(_score(parts, total, distinct, mean, filter_), schema), "lm-scores")

    m, w = len(MAGNITUDES) + 1, len(WEIGHTS)
    fit = scored.where("fit is not null").agg(*(F.coalesce(F.sum(F.col("fit")[i]), F.lit(0.0)).alias(f"f{i}") for i in range(m * w))).first()
    best = np.array(fit).reshape(m, w).argmax(axis=1) + np.arange(m) * w
    mixed = F.col("fixed")
    for i in best.tolist():
        mixed = mixed + F.col("sums")[i]
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", mixed.alias("score"))
