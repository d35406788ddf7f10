"""Ranked lexical search: the best documents for each of a stated set of items, by MaxScore within shards of documents.

The items' terms are broadcast, in blocks of items of bounded size.  One pass over the documents cuts them into shards of
bounded bytes and writes each shard's postings (for a term, its documents and how often they hold it) and the documents'
numbers of terms; counts over all shards give the terms' weights.  A second pass ranks each shard for each item: a term's
upper bound is its weight times its best part in the shard; the terms of least bounds, which together can't reach the
score of the item's k-th best document so far, are non-essential.  Documents come from the essential terms' lists alone, and
the others are probed, the greatest bound first, only for documents that can still qualify.  The k-th best score is kept
from shard to shard of a task.  Each task gives k documents for an item at most; these meet in two steps, first in groups.

A document's score sums weight * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included, with m =
75 + (25 n N) div L, n its terms, N the documents with terms and L all their terms; the weight is
floor(1000 ln((2 N + 2) / (2 df + 1))).

Defined cases: a null or empty text has no terms and is no result; an item without id or without terms has no results;
rows of one item_id are one item, whose terms they have together; each row of documents is a document of its own, also
with a doc_id that others have; equal scores are ordered by doc_id, those without one last; a very long text is a shard of
its own; an empty table on either side gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Bytes of items whose terms are broadcast at once, and of text in a shard (or one longer text).
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 2 << 20
#: Groups in which the tasks' results for an item meet first.
GROUPS = 64

SHARD_SCHEMA = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, counts binary, docs binary, times binary, large boolean"


class Terms:
    """The distinct terms of a block of items, and each item's terms with repeats."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        raw = [(t or "").encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = C.lower_table()[np.frombuffer(b"".join(raw), np.uint8)]
        w = C.words(data, offsets, C.alnum_words())
        texts = [data[a:z].tobytes() for a, z in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        known = {t: h for t, h in zip(texts, w.hash.tolist(), strict=True)}
        if len(set(known.values())) < len(known):
            raise ValueError("two terms of the items have one hash")
        names = sorted(known, key=known.__getitem__)
        number = {t: i for i, t in enumerate(names)}
        self.hashes = np.array([known[t] for t in names], np.uint64)
        self.edges = np.concatenate([[0], np.cumsum([len(t) for t in names])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(names), np.uint8)
        each: dict[int, list[int]] = {}
        for doc, t in zip(w.doc.tolist(), texts, strict=True):
            each.setdefault(items[doc][0], []).append(number[t])
        self.items = {k: np.unique(np.array(v), return_counts=True) for k, v in each.items()}

    def __len__(self) -> int:
        return len(self.hashes)

    def of(self, data: np.ndarray, w: C.Words) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms, and which ones; compared byte by byte."""
        at = np.minimum(np.searchsorted(self.hashes, w.hash), len(self.hashes) - 1)
        word = np.flatnonzero((self.hashes[at] == w.hash) & (self.edges[at + 1] - self.edges[at] == w.end - w.start))
        at = at[word]
        same = np.ones(len(word), bool)
        for part in np.array_split(np.arange(len(word)), len(word) // 50_000 + 1):
            n = w.end[word[part]] - w.start[word[part]]
            if len(n):
                differ = data[C.ragged(w.start[word[part]], n)] != self.data[C.ragged(self.edges[at[part]], n)]
                same[part] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        return word[same], at[same]


def _shards(sent, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, low, inside = sent.value, C.lower_table(), C.alnum_words()
        for batch in batches:
            for s in C.slices(batch.column("text"), most):
                data = low[s.data]
                w = C.words(data, s.offsets, inside)
                lengths = np.bincount(w.doc, minlength=s.n)
                word, term = terms.of(data, w)
                key, times = np.unique(term * s.n + w.doc[word], return_counts=True)
                term, doc = key // s.n, key % s.n
                start = C.starts_of(term)
                large = s.n > 1 << 16 or bool(len(times)) and int(times.max()) >= 1 << 16
                kind = "<u4" if large else "<u2"
                ids = batch.column("doc_id").slice(s.first, s.n)
                known = np.asarray(ids.is_valid()).astype(np.int64)
                packed = [
                    np.stack([known, ids.fill_null(0).to_numpy(zero_copy_only=False)]).astype("<i8"), lengths.astype("<i8"), term[start].astype("<u4"), np.diff(np.append(start, len(term))).astype("<u4"), doc.astype(kind), times.astype(kind)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), *(pa.array([x.tobytes()], pa.binary()) for x in packed), pa.array([large])],
                    ["n_docs", "n_terms", "ids", "lengths", "terms", "counts", "docs", "times", "large"],
                )
        C.release()

    return run


def _frequencies(n: int):
    """term, df of a task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for terms, counts in zip(b.column("terms").to_pylist(), b.column("counts").to_pylist(), strict=True):
                total[np.frombuffer(terms, "<u4")] += np.frombuffer(counts, "<u4")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    return run


class Shard:
    """Postings of one shard with the parts of the score that don't depend on an item."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        kind = "<u4" if row["large"] else "<u2"
        self.known, self.ids = np.frombuffer(row["ids"], "<i8").reshape(2, -1)
        lengths = np.frombuffer(row["lengths"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<u4").astype(np.int64)
        counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self.edges = np.concatenate([[0], np.cumsum(counts)])
        self.docs = np.frombuffer(row["docs"], kind).astype(np.int64)
        times = np.frombuffer(row["times"], kind).astype(np.int64)
        m = 75 + (25 * lengths * n_docs) // max(1, n_terms)
        self.parts = (10**9 * times) // (1000 * times + 12 * m[self.docs]) * np.repeat(weights[self.terms], counts)
        self.best = np.maximum.reduceat(self.parts, self.edges[:-1]) if len(counts) else np.zeros(0, np.int64)

    def ranked(self, terms: np.ndarray, repeats: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score of at least ``least`` (1 or more), and their scores."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        here = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else at[:0]
        at, repeats = at[here], repeats[here]
        bound = self.best[at] * repeats
        order = np.argsort(bound, kind="stable")
        at, repeats, bound = at[order], repeats[order], bound[order]
        reach = np.cumsum(bound)
        spare = int(np.searchsorted(reach, least, "left"))  # these together stay under least: non-essential
        if spare == len(at):
            return at[:0], at[:0]
        start, n = self.edges[at[spare:]], np.diff(self.edges)[at[spare:]]
        place = C.ragged(start, n)
        scores = np.zeros(len(self.ids), np.int64)
        np.add.at(scores, self.docs[place], self.parts[place] * np.repeat(repeats[spare:], n))
        docs = np.flatnonzero(scores)
        for k in range(spare - 1, -1, -1):
            docs = docs[scores[docs] + reach[k] >= least]
            if not len(docs):
                break
            a, z = self.edges[at[k]], self.edges[at[k] + 1]
            own = self.docs[a:z]
            found = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            hit = own[found] == docs
            scores[docs[hit]] += self.parts[a + found[hit]] * repeats[k]
        docs = docs[scores[docs] >= least]
        return docs, scores[docs]


class Best:
    """The k best documents of an item so far, and the least score that a further one needs."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.known, self.ids, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, score: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        score, known, ids = np.concatenate([self.score, score]), np.concatenate([self.known, known]), np.concatenate([self.ids, ids])
        top = np.lexsort((ids, 1 - known, -score))[: self.k]
        self.score, self.known, self.ids = score[top], known[top], ids[top]
        if len(top) == self.k:
            self.least = max(1, int(self.score[-1]))


def _ranked(sent, k: int, n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        best = {i: Best(k) for i in items}
        for batch in batches:
            for n in range(batch.num_rows):
                shard = Shard(batch.slice(n, 1).to_pylist()[0], weights, n_docs, n_terms)
                for i, (terms, repeats) in items.items():
                    docs, scores = shard.ranked(terms, repeats, best[i].least)
                    if len(docs):
                        best[i].add(scores, shard.known[docs], shard.ids[docs])
        for i, b in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), i)), pa.array(b.ids, mask=b.known == 0), pa.array(b.score)], ["item", "doc_id", "score"])
        C.release()

    return run


def best_of(rows: DataFrame, k: int, by: list, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best of docs (doc_id, text) for each of items (item_id, text)."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    stated = items.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = int(stated.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks, found = max(1, -(-size // block_bytes)), None
    for b in range(blocks):
        rows = (stated if blocks == 1 else stated.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)).collect()
        ids = list({r[0]: None for r in rows})
        number = {x: i for i, x in enumerate(ids)}
        terms = Terms([(number[r[0]], r[1]) for r in rows])
        if not len(terms):
            continue
        sent = spark.sparkContext.broadcast(terms)
        shards = C.stored(C.text_of(docs).mapInArrow(_shards(sent, shard_bytes), SHARD_SCHEMA), "search-shards")
        n_docs, n_terms = (int(x or 0) for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        df = np.zeros(len(terms), np.int64)
        counted = shards.select("terms", "counts").mapInArrow(_frequencies(len(terms)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        for r in counted.collect():  # a row for each term of the items at most
            df[r.term] = r.df
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        plan = spark.sparkContext.broadcast((terms.items, weights))
        each = shards.mapInArrow(_ranked(plan, k, n_docs, n_terms), "item long, doc_id long, score long")
        few = best_of(each.withColumn("part", F.spark_partition_id() % GROUPS), k, ["item", "part"], "rank").drop("rank", "part")
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}")
        own = best_of(few, k, ["item"], "rank").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = own if found is None else found.unionByName(own)
    return found if found is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def oracle_sql(k: int = 20) -> str:
    """DuckDB SQL for the rows of ``search`` over documents and benchmark."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY 1, 2),
q AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest({words}) AS t FROM benchmark) WHERE item_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), s),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, s),
x AS (SELECT item_id, r, CAST(sum(q.n * f.weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x JOIN m USING (r) WHERE score > 0 QUALIFY rank <= {k}
"""
