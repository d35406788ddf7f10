"""Language of a text by a byte convolutional network, trained in numpy.

A text is cut into windows of a fixed number of bytes that cover all of it (the last is padded with byte 0).  A window
passes an embedding of bytes, filters of several widths, the maximum over positions of each filter with a rectifier,
and a softmax; a text's language has the greatest mean log-probability over its windows.  As the embedding and a
filter's tap are both linear, a trained network is applied by tables: a filter's value is the sum over its taps of a
table's row for the byte there.

Training takes a bounded sample of labelled rows, by a hash of the row, the same number of each language at most, and
all windows of their texts, or a bounded sample of these, by a hash, if they are very many.  Tasks cut the texts into
windows; only windows reach the driver, which trains.  Every labelled language is learned.

Defined cases: a null text or one without any letter is ``und`` with score 0; null languages aren't learned from; if
nothing can be learned every text is ``und``; a row with a null doc_id gets its language, isn't held out and isn't
learned from; rows with one doc_id are rows of their own, each with its own label; equal rows are learned from once and
each give a row; of languages that tie, the first in the order of names is taken; a very long text is read whole; an
empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows of each language that training takes at most, and of all together if languages are very many (one row
#: of each language it takes in any case).
SAMPLE, SAMPLE_ALL = 600, 20_000
#: Windows of all sampled rows that training takes at most.
SAMPLE_WINDOWS = 400_000
LENGTH, WIDTHS, FILTERS, EMBEDDING = 128, (2, 3, 4), 24, 12


class Network(NamedTuple):
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # width, embedding, filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """All of the bytes in rows of a fixed length, the last one padded."""
    n = max(1, -(-len(data) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, length)


def _forward(net: Network, x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Pooled features of windows, and for each width the unfolded input and the places of the maxima."""
    e = net.embedding[x]
    pooled, kept, at = [], [], 0
    for f in net.filters:
        w, d, k = f.shape
        n = x.shape[1] - w + 1
        unfolded = np.concatenate([e[:, i : i + n] for i in range(w)], axis=2)
        value = unfolded @ f.reshape(w * d, k) + net.bias[at : at + k]
        best = value.argmax(axis=1)
        pooled.append(np.take_along_axis(value, best[:, None], 1)[:, 0])
        kept.append((unfolded, best))
        at += k
    return np.concatenate(pooled, axis=1), kept


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of windows, and its gradients: embedding, filters, bias, out, out_bias."""
    pooled, kept = _forward(net, x)
    h = np.maximum(pooled, 0)
    z = h @ net.out + net.out_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    at = np.arange(len(x)), y
    loss = float(-np.log(z[at]).mean())
    z[at] -= 1
    z /= len(x)
    dh = (z @ net.out.T) * (pooled > 0)
    embedding, filters = np.zeros_like(net.embedding), []
    for j, (flt, (unfolded, best)) in enumerate(zip(net.filters, kept, strict=True)):
        w, d, n = flt.shape
        g = dh[:, j * n : (j + 1) * n]
        seen = unfolded[np.arange(len(x))[:, None], best]  # rows, filters, width * embedding
        filters.append(np.einsum("rf,rfe->ef", g, seen).reshape(w, d, n))
        back = np.einsum("rf,wdf->rfwd", g, flt)
        bytes_at = x[np.arange(len(x))[:, None, None], best[:, :, None] + np.arange(w)]
        np.add.at(embedding, bytes_at.ravel(), back.reshape(-1, d))
    return loss, [embedding, *filters, dh.sum(axis=0), h.T @ z, z.sum(axis=0)]


def start(names: list[str], r: np.random.Generator) -> list[np.ndarray]:
    """First parameters, in the order of ``gradients``."""
    k = FILTERS * len(WIDTHS)
    return [r.normal(0, 0.3, (256, EMBEDDING)), *(r.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS), np.zeros(k), r.normal(0, k**-0.5, (k, len(names))), np.zeros(len(names))]


def network(names: list[str], p: list[np.ndarray]) -> Network:
    f = len(WIDTHS)
    return Network(names, p[0], p[1 : 1 + f], *p[1 + f :])


def train(texts: list[str], languages: list[str], **options) -> Network:
    """A network from all windows of the texts."""
    xs = [windows(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    return train_windows(np.concatenate(xs), np.repeat(languages, [len(w) for w in xs]).tolist(), **options)


def train_windows(x: np.ndarray, languages: list[str], epochs: int = 2, batch: int = 64, rate: float = 2e-3, seed: int = 7) -> Network:
    """Cross-entropy by Adam over the windows, each with its language."""
    r = np.random.default_rng(seed)
    names = sorted(set(languages))
    number = {n: i for i, n in enumerate(names)}
    y = np.array([number[lang] for lang in languages])
    p = [a.astype(np.float32) for a in start(names, r)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    # few windows are gone through more often, so that there are some hundred steps in any case
    for _ in range(max(epochs, -(-400 * batch // len(x)))):
        for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
            _, grads = gradients(network(names, p), x[rows], y[rows])
            step += 1
            for a, g, mm, vv in zip(p, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return network(names, p)


class Applied:
    """A trained network as tables: for each width and pair of taps, what two bytes add to each filter."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.taps = [[net.embedding @ f[i] for i in range(f.shape[0])] for f in net.filters]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = []
        for taps in self.taps:
            n = x.shape[1] - len(taps) + 1
            value = taps[0][x[:, :n]]
            for i, t in enumerate(taps[1:], 1):
                value += t[x[:, i : i + n]]
            pooled.append(value.max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0) @ self.net.out + self.net.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and its probability for each document of the bytes."""
        lengths = np.diff(offsets)
        n = np.maximum(1, -(-lengths // length))
        owner = np.repeat(np.arange(len(n)), n)
        start = np.repeat(offsets[:-1], n) + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * length
        stop = np.minimum(start + length, np.repeat(offsets[1:], n))
        padded = np.concatenate([data, np.zeros(length, np.uint8)])
        total = np.zeros((len(n), len(self.net.languages)))
        for i in range(0, len(owner), block):
            s = slice(i, i + block)
            x = padded[start[s, None] + np.arange(length)]
            x[np.arange(length) >= (stop[s] - start[s])[:, None]] = 0
            np.add.at(total, owner[s], self.log_probabilities(x) * np.maximum(1, stop[s] - start[s])[:, None])
        mean = total / np.maximum(1, lengths)[:, None]
        best = mean.argmax(axis=1)
        e = np.exp(mean - mean.max(axis=1, keepdims=True))
        return best, (1 / e.sum(axis=1)).clip(0, 1)


def sample(docs: DataFrame, rows: str, most: int = SAMPLE, most_of_all: int = SAMPLE_ALL) -> DataFrame:
    """text, label of at most ``most`` labelled rows of each language, from rows that the condition admits.

    Rows are chosen by their hashes first: each task and language passes on its own least ones, so no language's rows meet."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("doc_id is not null and lang is not null and length(text) > 0").where(rows).withColumn("h", F.xxhash64("doc_id", "text"))
    languages = known.agg(F.approx_count_distinct("lang")).first()[0]
    most = min(most, max(1, most_of_all // max(1, languages)))
    spread = known.select("lang", "doc_id", "h").withColumn("part", F.pmod("h", F.lit(256)))
    key = F.xxhash64("h"), "h", "doc_id"
    share = spread.withColumn("n", F.dense_rank().over(Window.partitionBy("lang", "part").orderBy(*key))).where(F.col("n") <= -(-most // 256) * 2 + 16).distinct()
    chosen = share.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("n", *key))).where(F.col("k") <= most).select("lang", "doc_id", "h")
    return known.join(F.broadcast(chosen), ["lang", "doc_id", "h"]).dropDuplicates(["lang", "doc_id", "h"]).select("text", F.col("lang").alias("label"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text (a digest), place and bytes of each window."""
    for batch in batches:
        for s in C.slices(batch.column("text")):
            for i in range(s.n):
                own = s.data[s.offsets[i] : s.offsets[i + 1]]
                w = windows(own)
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest()
                label = batch.column("label").slice(s.first + i, 1).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(label * len(w), pa.string()), pa.array([digest] * len(w)), pa.array(np.arange(len(w))), pa.array([x.tobytes() for x in w], pa.binary())], ["label", "digest", "place", "bytes"])


def fit(docs: DataFrame, rows: str = "true", most: int = SAMPLE_WINDOWS) -> Network | None:
    cut = C.stored(sample(docs, rows).mapInArrow(_cut, "label string, digest string, place long, bytes binary"), "language-windows")
    key = F.xxhash64("digest", "place")
    chosen = cut if cut.count() <= most else cut.orderBy(key, "digest", "place", "label").limit(most)
    got = sorted((r.label, r.digest, r.place, bytes(r.bytes)) for r in chosen.collect())
    return train_windows(np.frombuffer(b"".join(r[3] for r in got), np.uint8).reshape(-1, LENGTH), [r[0] for r in got]) if got else None


def languages(docs: DataFrame, held_out: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; rows for which ``held_out`` holds aren't learned from."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, f"not ({held_out})"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        own = Applied(net) if net else None
        for batch in batches:
            lettered = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for s in C.slices(batch.column("text")):
                best, score = own.predict(s.data, s.offsets) if own else (np.zeros(s.n, int), np.zeros(s.n))
                good = lettered[s.first : s.first + s.n] & (own is not None)
                names = [net.languages[k] if g else "und" for k, g in zip(best.tolist(), good.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.n), pa.array(names, pa.string()), pa.array(np.where(good, score, 0.0))], ["doc_id", "lang_pred", "score"])

    found = C.text_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "lang_pred", "score")
