"""Vector codes by product quantisation in integers.

Components become integers, vectors are cut into equal parts, and each part position has a codebook that begins as that
part of the first vectors.  The codebooks are broadcast; tasks compute the squared distances of whole batches of parts to
all entries as |x|^2 - 2 x.c + |c|^2 by int64 matrix products, and take the first of the least ones.  For each round a
task sends the sums and counts of each entry's parts, which a grouped shuffle adds; only these sums, as many as codebooks
have components, reach the driver.

Numbers are exact: int64 arithmetic that wraps gives the right distance wherever that itself fits, which LARGEST sees to.
Sums of components are exact up to 2^63 / LARGEST vectors for an entry, errors up to 2^63; beyond that Spark's sums raise.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; a vector whose length can't
be cut into the parts, or with a component beyond LARGEST, is an error; vectors of different lengths have codebooks of
their own; an empty vector has parts without components, code 0 and error 0; of rows with one vec_id the one with the
lesser bytes (its integers as little-endian int32) comes first, and rows without vec_id come last; with fewer vectors than entries there are as many entries
as vectors; equal labels are compared as text, nulls are one label; an empty table gives no rows; other columns aren't
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import join_heavy

#: Integers beyond which distances might not fit into 64 bits: (2 * 2**26)**2 for each of up to 256 components of a part.
LARGEST, MOST_COMPONENTS = 1 << 26, 256
#: Rows whose distances a task computes at once.
ROWS = 8192


def _integers(scale: int):
    """vec_id, label, length and integers (packed int32) of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = v.flatten()
            x = np.asarray(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
            n = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(n)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            keep = np.flatnonzero(np.asarray(v.is_valid()) & (bad[edges[1:]] == bad[edges[:-1]]))
            with np.errstate(invalid="ignore"):
                whole = np.floor(x * scale)
            if (np.abs(whole[C.ragged(edges[:-1][keep], n[keep])]) > LARGEST).any():
                raise ValueError(f"components must be at most {LARGEST} in size after scaling")
            raw = np.nan_to_num(whole, nan=0.0, posinf=0.0, neginf=0.0).astype("<i4")
            packed = pa.array([raw[a:z].tobytes() for a, z in zip(edges[:-1][keep].tolist(), edges[1:][keep].tolist(), strict=True)], pa.binary())
            part = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(n[keep], pa.int32()), packed], ["vec_id", "label", "dim", "raw"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """int64 rows of a column of packed integers."""
    data, _ = C.buffers(column)
    return data.view("<i4").reshape(-1, dim).astype(np.int64) if dim else np.zeros((len(column), 0), np.int64)


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part (rows, parts), the lesser among equals, and squared distances; codebooks (parts, entries, size)."""
    parts, _, size = codebooks.shape
    codes, errors = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    for p in range(parts):
        own, book = x[:, p * size : (p + 1) * size], codebooks[p]
        d = (own * own).sum(axis=1)[:, None] - 2 * (own @ book.T) + (book * book).sum(axis=1)
        codes[:, p] = d.argmin(axis=1)
        errors[:, p] = d[np.arange(len(x)), codes[:, p]]
    return codes, errors


def _sums(sent):
    """part, entry, position, total and count over a task's rows: position -1 has no component and gives the count alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        parts, entries, size = books.shape
        total, count = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.slice(at, ROWS).column("raw"), parts * size)
                codes, _ = nearest(x, books)
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    own = codes[order, p]
                    start = C.starts_of(own)
                    count[p] += np.bincount(own, minlength=entries)
                    total[p, own[start]] += np.add.reduceat(x[order, p * size : (p + 1) * size], start, axis=0)
        p, e = np.nonzero(count)
        used = total[p, e]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, size)), pa.array(np.repeat(e, size)), pa.array(np.tile(np.arange(size), len(p))), pa.array(used.ravel()), pa.array(np.repeat(count[p, e], size))],
            ["part", "entry", "position", "total", "n"],
        )

    return run


def _coded(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        parts, _, size = books.shape
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                codes, errors = nearest(_matrix(own.column("raw"), parts * size), books)
                text = codes.astype(np.uint8).tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array([text[i : i + step] for i in range(0, len(text), step)]), pa.array(errors.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return run


def trained(vectors: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, size) of packed integer vectors (vec_id, raw) of one length."""
    size = dim // parts
    first = vectors.select("vec_id", "raw").orderBy(F.col("vec_id").asc_nulls_last(), "raw").limit(entries).collect()
    books = np.array([np.frombuffer(r.raw, "<i4") for r in first], np.int64).reshape(len(first), parts, size).transpose(1, 0, 2).copy()
    for _ in range(rounds if size else 0):
        sent = vectors.sparkSession.sparkContext.broadcast(books)
        merged = vectors.select("raw").mapInArrow(_sums(sent), "part long, entry long, position long, total long, n long").groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in merged.collect():  # a row for each component of the codebooks
            books[r.part, r.entry, r.position] = r.total // r.n
        sent.unpersist()
    return books


def codebook_text(books: np.ndarray) -> str:
    """Components by part, entry, position, in decimal, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def codes(rows: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector of rows (vec_id, embedding, label) that is kept."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry is two hex digits: there are 256 at most")
    typed = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    kind = typed.schema["vec_id"].dataType.simpleString()
    kept = C.stored(typed.mapInArrow(_integers(scale), f"vec_id {kind}, label string, dim int, raw binary"), "codes-integers")
    found = None
    for dim in sorted(r.dim for r in kept.select("dim").distinct().collect()):
        if dim % parts or dim // parts > MOST_COMPONENTS:
            raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts of {MOST_COMPONENTS} components at most")
        own = kept.where(F.col("dim") == dim)
        books = trained(own, dim, parts, entries, rounds)
        sent = rows.sparkSession.sparkContext.broadcast(books)
        digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
        coded = own.select("vec_id", "label", "raw").mapInArrow(_coded(sent), f"vec_id {kind}, label string, code string, error long").withColumn("codebooks_sha256", F.lit(digest))
        found = coded if found is None else found.unionByName(coded)
    if found is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label")))
    found = C.stored(found.withColumn("key", key).drop("label"), "codes")
    labels = C.stored(found.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "codes-labels")
    return join_heavy(found, labels, "key", found.count()).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB SQL for the rows of ``codes`` over embeddings with distinct vec_ids and one length."""
    steps = []
    for r in range(rounds + 1):
        distance = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.c[i]) * (v.x[i] - b.c[i])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, arg_min(e, row(d, e)) AS e, min(d) AS d FROM (SELECT v.vec_id, v.part, v.x, b.e, CAST({distance} AS BIGINT) AS d FROM v JOIN b{r} b USING (part)) GROUP BY 1, 2)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT part, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM v))) AS i) GROUP BY 1, 2, 3)")
            steps.append(f"f{r} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{r} GROUP BY 1, 2)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(f{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN f{r} USING (part, e))")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda y: CAST(floor({scale} * y) AS BIGINT)) AS z FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
v AS MATERIALIZED (SELECT vec_id, p AS part, z[p * len(z) // {parts} + 1:(p + 1) * len(z) // {parts}] AS x FROM k, (SELECT unnest(range({parts})) AS p)),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {entries}),
b0 AS MATERIALIZED (SELECT part, e, x AS c FROM v JOIN o USING (vec_id)),
{", ".join(steps)},
t AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h FROM b{rounds}),
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM c JOIN k USING (vec_id), t
"""
