"""Near-duplicate embeddings by an exact metric range join over pivots.

On unit vectors a cosine of at least c is a Euclidean distance of at most r = sqrt(2 - 2c).  Each vector belongs to
the cell of its nearest pivot, and is packed with its cell's others into blocks of bounded size, once: disk grows with
the vectors.  Each block meets each later one in a task, which reads both; cells further apart than their radii and r
don't meet.  If x of cell i and y of cell j lie within r, the triangle inequality gives d(x, p_j) <= d(x, p_i) + 2r, the
distance of x from the plane halfway between the pivots is at most r, and d(x, p_j) <= radius of j + r, and so for y:
only rows that none of the three rules out are compared.  Products in single precision find candidates with a margin,
double precision decides.

Numbers of links are summed in each task and components kept as star edges; pairs never leave a task.  Equal vectors are
one class with a multiplicity.  In many dimensions vectors without structure lie about as far from all pivots: then nearly
all rows of nearly all blocks are compared, and time grows with the square of their number, but nothing else does.

Defined cases: a null or empty vector, one of length zero, or with a null or non-finite component links with nothing;
neither do vectors of different dimensions; rows with one vec_id are one node; a null vec_id has a null component;
an empty table gives no rows; other columns aren't looked at.  The margin of single precision holds for vectors of up to
about 1,600 components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected, join_heavy, least_of

#: Vectors of a cell as planned, the most pivots, and vectors of a block.
CELL, PIVOTS, BLOCK = 2048, 1024, 4096
#: Bytes of a file of blocks, as planned, and rows of links that a task holds before it sums them.
FILE_BYTES, HELD = 8 << 20, 1 << 20
#: More than distances are rounded by: they are roots of differences of about 1e-16.
SLACK = 1e-7


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are finite and not zero, and these over their norms."""
    top = np.abs(x).max(axis=1, initial=0.0)
    good = np.isfinite(x).all(axis=1) & (top > 0)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x[good] / top[good, None]
        norm = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
    return good, scaled / norm[:, None]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dimension, digest and doubles of the vectors; the last three null where a vector links with nothing."""
    for batch in batches:
        v = batch.column("v")
        flat = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64) + 0.0  # nulls are NaN, -0 is 0
        n = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(n) - n
        dim, digest, raw = ([None] * len(n) for _ in range(3))
        for k in np.unique(n[n > 0]).tolist():
            rows = np.flatnonzero(n == k)
            x = flat[start[rows][:, None] + np.arange(k)]
            good, unit = _units(x)
            for i, own, u in zip(rows[good].tolist(), x[good], unit, strict=True):
                dim[i], digest[i], raw[i] = k, hashlib.blake2b(own.tobytes(), digest_size=16).digest(), u.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dim, pa.int32()), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "dim", "digest", "unit"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _radii(sent):
    """Nearest pivot of each vector: inner vectors and radius of each cell, a row for each cell and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(b.column("unit"), pivots.shape[1]), pivots)
                near = d.argmin(axis=1)
                cells = np.unique(near)
                radius = [float(d[near == c, c].max()) for c in cells]
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.bincount(near)[cells]), pa.array(radius)], ["cell", "n", "radius"])

    return run


def _placed(sent):
    """Packed rows (block, ids, multiplicities, vectors), of many blocks in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, _, blocks = sent.value
        first = np.cumsum(blocks) - blocks
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                x, ids, n = _matrix(b.column("unit"), pivots.shape[1]), b.column("rep").to_numpy(), b.column("n").to_numpy()
                near = _distances(x, pivots).argmin(axis=1)
                block = first[near] + (C.mix(ids.view(np.uint64)) % blocks[near].astype(np.uint64)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                cut = C.starts_of(block[order])
                parts = [order[i:j] for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block[order[cut]]), *(pa.array([v[rows].tobytes() for rows in parts], pa.binary()) for v in (ids, n, x))], ["block", "ids", "n", "units"])

    return run


def _packed(sent, r: float):
    """A row for each block, from rows sorted by block, with its cell and the cells whose rows may lie within r of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, blocks = sent.value
        cells = np.repeat(np.arange(len(blocks)), blocks)

        def row(block: int, parts: list[tuple]) -> pa.RecordBatch:
            cell = int(cells[block])
            meets = np.union1d(np.flatnonzero(_distances(pivots[cell : cell + 1], pivots)[0] <= radius[cell] + radius + r + SLACK), [cell])
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([cell]), pa.array([meets.tolist()], pa.list_(pa.int64())), *(pa.array([b"".join(v)], pa.binary()) for v in zip(*parts, strict=True))], ["block", "cell", "meets", "ids", "n", "units"])

        last, parts = None, []
        for b in batches:
            for block, *values in zip(*(b.column(c).to_pylist() for c in ("block", "ids", "n", "units")), strict=True):
                if block != last and parts:
                    yield row(last, parts)
                    parts = []
                last = block
                parts.append(tuple(values))
        if parts:
            yield row(last, parts)

    return run


class _Labels:
    """Components of numbered rows, merged by pairs of labels."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            differ = x != y
            if not differ.any():
                return
            low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
            to = np.arange(len(self.of))
            np.minimum.at(to, high, low)
            while (to[to] != to).any():
                to = to[to]
            self.of = to[self.of]


def _near(x: np.ndarray, own: int, other: int, pivots: np.ndarray, radius: np.ndarray, r: float) -> np.ndarray:
    """Rows of a cell that may have a row of the other cell within r."""
    home, away = (_distances(x, pivots[c : c + 1])[:, 0] for c in (own, other))
    between = max(1e-12, float(_distances(pivots[own : own + 1], pivots[other : other + 1])[0, 0]))
    return np.flatnonzero((away <= home + 2 * r + SLACK) & (away * away - home * home <= 2 * between * r + SLACK) & (away <= radius[other] + r + SLACK))


def _joined(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...] | None, cosine: float) -> tuple[np.ndarray, ...]:
    """ids, numbers of links and least linked rows of two blocks (ids, multiplicities, vectors), or of one with itself."""
    i, m, x = a if b is None else (np.concatenate(v) for v in zip(a, b, strict=True))
    single, asks, start = x.astype(np.float32), len(a[0]), 0 if b is None else len(a[0])
    links, labels = np.zeros(len(i), np.int64), _Labels(len(i))
    for at in range(0, asks, 256):
        p, q = np.nonzero(single[at : min(at + 256, asks)] @ single[start:].T >= np.float32(cosine - 1e-4))
        p, q = p + at, q + start
        up = q > p
        p, q = p[up], q[up]
        for s in range(0, len(p), 1 << 16):
            pp, qq = p[s : s + (1 << 16)], q[s : s + (1 << 16)]
            sure = np.einsum("ij,ij->i", x[pp], x[qq]) >= cosine
            pp, qq = pp[sure], qq[sure]
            links += np.bincount(pp, weights=m[qq], minlength=len(i)).astype(np.int64) + np.bincount(qq, weights=m[pp], minlength=len(i)).astype(np.int64)
            labels.merge(pp, qq)
    some = np.flatnonzero(links)
    return i[some], links[some], i[labels.of[some]]


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """A row for each id: the sum of its links, and the least id that the edges of all rows connect it with."""
    ids, links, other = (np.concatenate(v) for v in zip(*parts, strict=True))
    every, least = least_of(ids, other)
    own, at = np.unique(ids, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, links)
    return own, total, least[np.searchsorted(every, own)]


def _join(sent, r: float, cosine: float):
    """Rows of two blocks each, a and b, to (id, links, other): numbers of links, and star edges to the least row of each
    component of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, blocks = sent.value
        cell = np.repeat(np.arange(len(blocks)), blocks)
        parts, held, most = [], 0, HELD

        def block(b: pa.RecordBatch, k: int, side: str) -> tuple[np.ndarray, ...]:
            ids, n, units = (b.column(side + c)[k].as_buffer() for c in ("ids", "n", "units"))
            return np.frombuffer(ids, np.int64), np.frombuffer(n, np.int64), np.frombuffer(units, np.float64).reshape(-1, pivots.shape[1])

        for b in batches:
            for k, (i, j) in enumerate(zip(b.column("a_block").to_pylist(), b.column("b_block").to_pylist(), strict=True)):
                one, two = block(b, k, "a_"), block(b, k, "b_") if i != j else None
                if cell[i] != cell[j]:
                    some, others = _near(one[2], cell[i], cell[j], pivots, radius, r), _near(two[2], cell[j], cell[i], pivots, radius, r)
                    one, two = tuple(v[some] for v in one), tuple(v[others] for v in two)
                found = _joined(one, two, cosine)
                if len(found[0]):
                    parts.append(found)
                    held += len(found[0])
                if held > most:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    most = max(HELD, 2 * held)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in _summed(parts)], ["id", "links", "other"])

    return run


def range_join(classes: DataFrame, dim: int, cosine: float, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """id, links, other of classes (rep, n, unit) of one dimension, in parts: links of an id are to be summed, and
    (id, other) are edges that connect what links connect."""
    spark = classes.sparkSession
    r = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    count = classes.count()
    k = max(1, min(PIVOTS, -(-count // cell)))
    chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(k).collect()
    pivots = np.array([np.frombuffer(x.unit, np.float64) for x in chosen]).reshape(-1, dim)
    sent = spark.sparkContext.broadcast(pivots)
    sizes = classes.select("unit").mapInArrow(_radii(sent), "cell long, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    radius, blocks = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for s in sizes:
        radius[s.cell], blocks[s.cell] = s.radius, -(-s.n // block)
    plan = spark.sparkContext.broadcast((pivots, radius, blocks))
    files = max(1, min(int(blocks.sum()), max(C.tasks(spark), -(-count * 8 * dim // FILE_BYTES))))
    placed = classes.select("rep", "n", "unit").mapInArrow(_placed(plan), "block long, ids binary, n binary, units binary")
    packed = C.stored(placed.repartition(files, "block").sortWithinPartitions("block").mapInArrow(_packed(plan, r), "block long, cell long, meets array<long>, ids binary, n binary, units binary"), "embedding-blocks")
    # Pairs of the table's own rows by a plain join: none is dealt, a task reads what it joins.
    a, b = (packed.select(*(F.col(c).alias(f"{side}_{c}") for c in packed.columns)) for side in "ab")
    pairs = a.join(b, (F.col("a_block") <= F.col("b_block")) & F.array_contains("a_meets", F.col("b_cell")))
    return pairs.drop("a_cell", "a_meets", "b_cell", "b_meets").mapInArrow(_join(plan, r, cosine), "id long, links long, other long")


def links(rows: DataFrame, cosine: float = 0.95, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each vector; links have at least the cosine."""
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    # In doubles all along, in tasks of bounded size: a vector has hundreds of bytes.
    every = C.stored(vectors.mapInArrow(_vectors, "vec_id long, dim int, digest binary, unit binary"), "embedding-vectors")
    full = every.where("digest is not null and vec_id is not null")
    classes = C.stored(full.groupBy("digest", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit")), "embedding-classes")
    found = None
    for dim in sorted(x.dim for x in classes.select("dim").distinct().collect()):
        own = range_join(classes.where(F.col("dim") == dim), dim, cosine, cell, block)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = C.stored(found, "embedding-links")
    components = connected(found.select(F.col("id").alias("a"), F.col("other").alias("b")), "embedding-components")
    summed = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = (
        classes.select("digest", "rep", "n").join(summed, F.col("rep") == F.col("id"), "left").drop("id").join(components, F.col("rep") == F.col("id"), "left")
        .select("digest", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    placed = join_heavy(full.select("vec_id", "digest"), C.stored(of, "embedding-groups"), "digest", full.count()).select("vec_id", "n_links", "component_id")
    alone = every.where("digest is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
