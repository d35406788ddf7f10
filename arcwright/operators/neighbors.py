"""Exact k nearest neighbours within each curve, by position, over cells that follow the density.

A curve of more points than a task takes is cut into leaves by a tree of medians over a bounded sample: leaves are small
where points are dense and wide where they are sparse.  First each leaf finds the nearest points among its own; the
distance of the k-th bounds the rest, so a point is then sent only to the leaves whose boxes lie within its bound, which
the tree finds.  Within a task points lie in cells of at most CELL, cut at medians as well, and only cells within the
bound are compared.  Two passes are exact, however points lie.

Of points at one position only the k + 1 of least idx can be anybody's neighbours; the others have the first k of
them.  So many coinciding points are neither compared with each other nor dealt to one task.

Defined cases: a curve of n points gives each n - 1 neighbours at most; equal distances are ordered by idx; coinciding
points are neighbours at distance 0; rows with null or non-finite positions are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwright.functions import phasespace as P
from arcwright.spec import Spec
from arcwright.tables import stored

from .keyed import join_common, key_of, stream_of, tasks

#: Points of a task at least and at most, where a curve is cut; sampled points for each leaf; points of a cell; cells that
#: are compared at once.
LEAST_LEAF, LEAF, SAMPLED, CELL, AT_ONCE = 4096, 1 << 18, 16, 128, 16
#: Rows of all samples at most: beyond that leaves are larger.
SAMPLE_ROWS = 2_000_000


# -- within a task ------------------------------------------------------------------------------------------------


class Cells:
    """Points in cells of bounded size: their order by cell, where cells begin, boxes, and the least id of each."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, most: int) -> None:
        order, todo, cells = np.argsort(ids, kind="stable"), [], []
        todo.append(order)
        while todo:
            rows = todo.pop()
            if len(rows) > most:
                own = q[rows]
                spread = own.max(axis=0) - own.min(axis=0)
                by = rows[np.argsort(own[:, np.argmax(spread)], kind="stable")]
                half = len(by) // 2
                todo += [by[half:], by[:half]]
            elif len(rows):
                cells.append(rows)
        self.rows = np.concatenate(cells) if cells else order
        self.start = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64)
        self.low = np.array([q[c].min(axis=0) for c in cells]).reshape(-1, q.shape[1])
        self.high = np.array([q[c].max(axis=0) for c in cells]).reshape(-1, q.shape[1])
        self.least = np.array([ids[c].min() for c in cells], np.int64)

    def of(self, cells: np.ndarray) -> np.ndarray:
        return np.concatenate([self.rows[self.start[c] : self.start[c + 1]] for c in cells.tolist()]) if len(cells) else self.rows[:0]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b), components added from first to last."""
    total = np.zeros((len(a), len(b)))
    for c in range(a.shape[1]):
        total += (b[:, c] - a[:, c : c + 1]) ** 2
    return np.sqrt(total)


def gaps(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """Least distances between boxes, pair by pair; never above a distance of points in them, as rounding is monotonic."""
    gap = np.maximum(0.0, np.maximum(low2 - high, low - high2))
    total = np.zeros(gap.shape[:-1])
    for c in range(gap.shape[-1]):
        total += gap[..., c] ** 2
    return np.sqrt(total)


def _merged(dist: np.ndarray, ids: np.ndarray, row: np.ndarray, d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by (distance, id), out of those so far and more (row, d, n)."""
    m, k = dist.shape
    row, d, n = np.concatenate([np.repeat(np.arange(m), k), row]), np.concatenate([dist.ravel(), d]), np.concatenate([ids.ravel(), n])
    order = np.lexsort((n, d, row))
    row = row[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    order = order[rank < k]
    return d[order].reshape(m, k), n[order].reshape(m, k)


def nearest(queries: np.ndarray, rows: np.ndarray | None, points: np.ndarray, ids: np.ndarray, k: int, far: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances (queries, k) of each query's nearest points, by (distance, id); infinite where there are none.

    With ``rows``, a query isn't its own neighbour.  With ``far`` and ``last``, only points before (far, last) are wanted."""
    m = len(queries)
    out_d, out_n = np.full((m, k), np.inf), np.full((m, k), np.iinfo(np.int64).max)
    if not m or not len(ids):
        return out_n, out_d
    cells = Cells(points, ids, CELL)
    blocks = Cells(queries, np.arange(m), CELL)
    limit_d = np.full(m, np.inf) if far is None else far
    limit_n = np.full(m, np.iinfo(np.int64).max) if last is None else last
    for b in range(len(blocks.least)):
        own = blocks.rows[blocks.start[b] : blocks.start[b + 1]]
        q = queries[own]
        reach = gaps(blocks.low[b], blocks.high[b], cells.low, cells.high)
        by = np.argsort(reach, kind="stable")
        dist, found = out_d[own], out_n[own]
        bound, tie = limit_d[own], limit_n[own]
        for a in range(0, len(by), AT_ONCE):
            some = by[a : a + AT_ONCE]
            if reach[some[0]] > bound.max():
                break
            gap = gaps(q[:, None], q[:, None], cells.low[some][None], cells.high[some][None])
            need = (gap < bound[:, None]) | ((gap == bound[:, None]) & (cells.least[some] < tie[:, None]))
            some, asks = some[need.any(axis=0)], np.flatnonzero(need.any(axis=1))
            if not len(some):
                continue
            at = cells.of(some)
            d = distances(q[asks], points[at])
            if rows is not None:
                d[rows[own[asks]][:, None] == ids[at]] = np.inf
            most = np.minimum(bound[asks], np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.inf)
            r, c = np.nonzero((d <= most[:, None]) & np.isfinite(d))
            if not len(r):
                continue
            new_d, new_n = _merged(dist[asks], found[asks], r, d[r, c], ids[at[c]])
            dist[asks], found[asks] = new_d, new_n
            closer = (dist[:, -1] < bound) | ((dist[:, -1] == bound) & (found[:, -1] < tie))
            bound, tie = np.where(closer, dist[:, -1], bound), np.where(closer, found[:, -1], tie)
        out_d[own], out_n[own] = dist, found
    beyond = (out_d > limit_d[:, None]) | ((out_d == limit_d[:, None]) & (out_n >= limit_n[:, None]))
    return out_n, np.where(beyond, np.inf, out_d)


# -- leaves -------------------------------------------------------------------------------------------------------


class Tree:
    """A complete binary tree of cuts at medians of a sample; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.dim, self.cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        parts = {0: sample}
        for node in range(len(self.dim)):
            own = parts.pop(node)
            if len(own):
                self.dim[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
                self.cut[node] = np.sort(own[:, self.dim[node]])[(len(own) - 1) // 2]
            right = own[:, self.dim[node]] > self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]

    def leaf(self, q: np.ndarray) -> np.ndarray:
        node = np.zeros(len(q), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (q[np.arange(len(q)), self.dim[node]] > self.cut[node])
        return node - len(self.dim)


class Boxes:
    """Boxes, numbers and least ids of the points under each node of a tree."""

    def __init__(self, depth: int, leaf: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, least: np.ndarray) -> None:
        first, dims = (1 << depth) - 1, low.shape[1]
        total = 2 * first + 1
        self.depth = depth
        self.low, self.high = np.full((total, dims), np.inf), np.full((total, dims), -np.inf)
        self.n, self.least = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
        self.low[first + leaf], self.high[first + leaf], self.n[first + leaf], self.least[first + leaf] = low, high, n, least
        for node in range(first - 1, -1, -1):
            a, b = 2 * node + 1, 2 * node + 2
            self.low[node], self.high[node] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])
            self.n[node], self.least[node] = self.n[a] + self.n[b], min(self.least[a], self.least[b])

    def within(self, q: np.ndarray, far: np.ndarray, last: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the leaves, but their own, that may hold points before (far, last)."""
        row, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        far = far.copy()
        for level in range(self.depth + 1):
            if level:
                row, node = np.repeat(row, 2), (2 * node[:, None] + np.array([1, 2])).ravel()
            full = self.n[node] > 0
            row, node = row[full], node[full]
            many = self.n[node] > k  # enough of them lie within the distance of the box's farthest corner
            edge = np.maximum(np.abs(self.high[node[many]] - q[row[many]]), np.abs(q[row[many]] - self.low[node[many]]))
            corner = np.full(len(q), np.inf)
            np.minimum.at(corner, row[many], np.sqrt((edge * edge).sum(axis=1)) * (1 + 1e-12))
            far = np.minimum(far, corner)
            gap = gaps(q[row], q[row], self.low[node], self.high[node])
            keep = (gap < far[row]) | ((gap == far[row]) & (self.least[node] < last[row]))
            row, node = row[keep], node[keep]
        leaf = node - ((1 << self.depth) - 1)
        other = leaf != own[row]
        return row[other], leaf[other]


def _vectors(batch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy() if isinstance(batch, pa.Table) else batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1) if batch.num_rows else np.zeros((0, len(names)))


def _by_key(keys: pa.Array):
    """Each distinct key of a batch with its rows."""
    coded = keys.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for i, key in enumerate(coded.dictionary.to_pylist()):
        yield key, np.flatnonzero(codes == i)


def _lists(n: np.ndarray, d: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Columns of lists of the finite entries of each row."""
    real = np.isfinite(d)
    edges = pa.array(np.concatenate([[0], np.cumsum(real.sum(axis=1))]), pa.int32())
    return pa.ListArray.from_arrays(edges, pa.array(n[real], pa.int64())), pa.ListArray.from_arrays(edges, pa.array(d[real]))


def _trees(rows: DataFrame, names: list[str], leaf: int | None) -> dict[str, Tree]:
    """Trees of the curves of more rows than a leaf takes, by a sample that the bound of leaves bounds."""
    sizes = rows.groupBy("_k").count()
    total, most = sizes.agg(F.sum("count"), F.max("count")).first()
    total = total or 0
    most_leaf = max(LEAF, 2 * SAMPLED * total // SAMPLE_ROWS)  # a curve has up to twice as many leaves as it fills
    leaf = leaf or min(most_leaf, max(LEAST_LEAF, total // (4 * tasks(rows))))
    if (most or 0) <= leaf:
        return {}
    large = sizes.where(F.col("count") > leaf).collect()
    depth = {r["_k"]: max(1, int(np.ceil(np.log2(r["count"] / leaf)))) for r in large}
    spark = rows.sparkSession
    share = spark.createDataFrame([(r["_k"], int(2**32 * min(1.0, SAMPLED * 2 ** depth[r["_k"]] / r["count"]))) for r in large], "_k string, _share long")
    sample = rows.join(F.broadcast(share), "_k").where(F.pmod(F.xxhash64("_i", *names), F.lit(2**32)) < F.col("_share")).select("_k", *names).toPandas()
    own = {k: v[names].to_numpy(float) for k, v in sample.groupby("_k")}
    return {k: Tree(own.get(k, np.zeros((0, len(names)))), d) for k, d in depth.items()}


def search(rows: DataFrame, names: list[str], k: int, leaf: int | None = None) -> DataFrame:
    """_k, _i, _near (array of structs _d, _n, by distance and id, k at most) of each row that asks.

    rows: _k, _i, components, _role: 0 is only asked about, 1 only asks, 2 does both and isn't its own neighbour.  No more
    than a few asked rows have one position."""
    spark, kinds = rows.sparkSession, ", ".join(f"{n} double" for n in names)
    trees = _trees(rows, names, leaf)
    if trees:
        sent = spark.sparkContext.broadcast(trees)

        def place(batches):
            for b in batches:
                q, leaves = _vectors(b, names), np.zeros(b.num_rows, np.int64)
                for key, own in _by_key(b.column("_k")):
                    if key in sent.value:
                        leaves[own] = sent.value[key].leaf(q[own])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves)], [*b.schema.names, "_leaf"])

        rows = stored(rows.select("_k", "_i", *names, "_role").mapInArrow(place, f"_k string, _i long, {kinds}, _role int, _leaf long"), "neighbour-leaves")
    else:
        rows = rows.select("_k", "_i", *names, "_role", F.lit(0).cast("long").alias("_leaf"))

    def inside(t: pa.Table) -> pa.Table:
        q, ids, role = _vectors(t, names), t.column("_i").to_numpy(), t.column("_role").to_numpy()
        asks, asked = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
        n, d = nearest(q[asks], np.where(role[asks] == 2, ids[asks], np.iinfo(np.int64).min) if (role == 2).any() else None, q[asked], ids[asked], k)
        out = t.take(pa.array(asks))
        return pa.Table.from_arrays([out.column("_k"), out.column("_i"), *(out.column(x) for x in names), out.column("_leaf"), *_lists(n, d)], ["_k", "_i", *names, "_leaf", "_n", "_d"])

    lists = lambda d, n: F.arrays_zip(F.col(d).alias("_d"), F.col(n).alias("_n"))
    first = rows.groupBy("_k", "_leaf").applyInArrow(inside, f"_k string, _i long, {kinds}, _leaf long, _n array<long>, _d array<double>")
    if not trees:
        return first.select("_k", "_i", lists("_d", "_n").alias("_near"))
    first = stored(first, "neighbour-leaf")
    held = rows.where("_role <> 1").join(F.broadcast(spark.createDataFrame([(x,) for x in trees], "_k string")), "_k", "left_semi")
    bounds = held.groupBy("_k", "_leaf").agg(F.count("*").alias("_m"), F.min("_i").alias("_least"), *(f(n).alias(f"{w}{n}") for n in names for w, f in (("_low", F.min), ("_high", F.max)))).toPandas()
    boxes = {
        key: Boxes(trees[key].depth, b["_leaf"].to_numpy(), b[[f"_low{n}" for n in names]].to_numpy(float), b[[f"_high{n}" for n in names]].to_numpy(float), b["_m"].to_numpy(), b["_least"].to_numpy())
        for key, b in bounds.groupby("_k") if key in trees
    }
    reach = spark.sparkContext.broadcast(boxes)

    def send(batches):
        for b in batches:
            q, ids, own_leaf = _vectors(b, names), b.column("_i").to_numpy(), b.column("_leaf").to_numpy()
            n, d = b.column("_n").combine_chunks() if isinstance(b.column("_n"), pa.ChunkedArray) else b.column("_n"), b.column("_d")
            size = n.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.cumsum(size)
            far, last = np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max)
            full = np.flatnonzero(size == k)
            far[full], last[full] = d.flatten().to_numpy()[end[full] - 1], n.flatten().to_numpy()[end[full] - 1]
            for key, own in _by_key(b.column("_k")):
                if key in reach.value:
                    row, leaf = reach.value[key].within(q[own], far[own], last[own], own_leaf[own], k)
                    at = own[row]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(ids[at]), *(pa.array(q[at, c]) for c in range(len(names))), pa.array(leaf), pa.array(far[at]), pa.array(last[at])], ["_k", "_i", *names, "_leaf", "_far", "_last"])

    def across(asks: pa.Table, t: pa.Table) -> pa.Table:
        n, d = nearest(_vectors(asks, names), None, _vectors(t, names), t.column("_i").to_numpy(), k, asks.column("_far").to_numpy(), asks.column("_last").to_numpy())
        some = np.flatnonzero(np.isfinite(d[:, 0])) if len(d) else np.zeros(0, np.int64)
        out = asks.take(pa.array(some))
        return pa.Table.from_arrays([out.column("_k"), out.column("_i"), *_lists(n[some], d[some])], ["_k", "_i", "_n", "_d"])

    asks = first.mapInArrow(send, f"_k string, _i long, {kinds}, _leaf long, _far double, _last long")
    more = asks.groupBy("_k", "_leaf").cogroup(held.groupBy("_k", "_leaf")).applyInArrow(across, "_k string, _i long, _n array<long>, _d array<double>")
    more = more.groupBy("_k", "_i").agg(F.flatten(F.collect_list(lists("_d", "_n"))).alias("_more"))
    near = F.slice(F.array_sort(F.concat(lists("_d", "_n"), F.coalesce("_more", F.array().cast("array<struct<_d:double,_n:bigint>>")))), 1, k)
    return first.join(more, ["_k", "_i"], "left").select("_k", "_i", near.alias("_near"))


def finite(df: DataFrame, stream: str, idx: str, q, names: list[str]) -> DataFrame:
    """_k, _i and components of the rows whose position is a finite one."""
    rows = df.select(key_of(F.col(stream)).alias("_k"), F.col(idx).cast("long").alias("_i"), *((F.col(c).cast("double") + 0.0).alias(n) for c, n in zip(q, names, strict=True)))
    for n in names:
        rows = rows.where(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")))
    return rows


def _crowded(points: DataFrame, names: list[str], k: int) -> tuple[DataFrame, DataFrame | None]:
    """The points that can be neighbours, and the others with theirs (_k, _i, _near), if more than k + 1 share a position."""
    place = F.struct("_k", *names)
    crowds = points.groupBy(place.alias("_p")).agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    if crowds.isEmpty():
        return points, None
    crowds = stored(crowds, "neighbour-crowds")
    total = points.count()
    rows = points.withColumn("_p", place)
    inside = stored(join_common(rows, crowds, "_p", total), "neighbour-crowd")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_i"))
    first = stored(inside.withColumn("_r", rank).where(F.col("_r") <= k + 1), "neighbour-first")
    lists = first.groupBy("_p").agg(F.max("_i").alias("_end"), F.array_sort(F.collect_list(F.struct(F.lit(0.0).alias("_d"), F.col("_i").alias("_n")))).alias("_near"))
    others = join_common(inside, lists.join(crowds, "_p"), "_p", total).where(F.col("_i") > F.col("_end")).select("_k", "_i", F.slice("_near", 1, k).alias("_near"))
    loose = rows.join(crowds.select("_p"), "_p", "left_anti") if crowds.count() > 10_000 else rows.join(F.broadcast(crowds.select("_p")), "_p", "left_anti")
    return loose.select(points.columns).unionByName(first.select(points.columns)), others


def knn(df: DataFrame, spec: Spec, k: int, leaf: int | None = None) -> DataFrame:
    """stream, idx, neighbor, distance, rank (from 1) of the k nearest other points of the same stream.

    A curve of more than ``leaf`` points is cut; without it, by the size of the table."""
    if k < 1:
        raise ValueError("k must be positive")
    names = [f"_q{i}" for i in range(len(spec.q))]
    points = stored(finite(df, spec.stream, spec.idx, spec.q, names), "neighbour-points")
    kept, others = _crowded(points, names, k)
    found = search(kept.withColumn("_role", F.lit(2)), names, k, leaf)
    if others is not None:
        found = found.unionByName(others)
    kind = df.schema[spec.stream].dataType
    rows = found.select("_k", "_i", F.posexplode("_near").alias("_r", "_x"))
    return rows.select(stream_of(F.col("_k"), kind).alias(spec.stream), F.col("_i").alias(spec.idx), F.col("_x._n").alias("neighbor"), F.col("_x._d").alias("distance"), (F.col("_r") + 1).alias("rank"))


def nearest_vertex(points: DataFrame, vertices: DataFrame, names: list[str], leaf: int | None = None) -> DataFrame:
    """_k, _i, _n, _d: for each of points (_k, _i, components) the nearest of vertices (_k, _n, components) of its curve,
    the lesser _n among equals; a curve without vertices gives no rows."""
    asked = vertices.groupBy("_k", *names).agg(F.min("_n").alias("_i"))
    points = stored(points.select("_k", "_i", *names), "vertex-points")
    places = stored(points.groupBy("_k", *names).agg(F.min("_i").alias("_i"), F.count("*").alias("n")), "vertex-places")
    rows = asked.select("_k", "_i", *names, F.lit(0).alias("_role")).unionByName(places.select("_k", "_i", *names, F.lit(1).alias("_role")))
    found = search(stored(rows, "vertex-rows"), names, 1, leaf).where(F.size("_near") > 0).select("_k", "_i", F.col("_near")[0]["_n"].alias("_n"), F.col("_near")[0]["_d"].alias("_d"))
    if places.where("n > 1").isEmpty():
        return found
    of_place = places.join(found, ["_k", "_i"]).select(F.struct("_k", *names).alias("_p"), "n", "_n", "_d")
    return join_common(points.withColumn("_p", F.struct("_k", *names)), stored(of_place, "vertex-found"), "_p", points.count()).select("_k", "_i", "_n", "_d")


def edges(df: DataFrame, spec: Spec, k: int, velocity_weight: float = 0.0, jump_cap: float = float("inf"), sever_cos_threshold: float | None = None) -> DataFrame:
    """stream, a, b (a < b), distance, cosine, weight: k-nearest links that are kept, once each.

    Kept are links of at most jump_cap in position and, with a threshold, of at least that cosine between velocities.  The
    weight is distance + velocity_weight * (1 - cosine).
    """
    links = knn(df, spec, k).select(F.col(spec.stream), F.least(spec.idx, "neighbor").alias("a"), F.greatest(spec.idx, "neighbor").alias("b"), "distance").distinct()
    typed = spec.typed(df)
    side = lambda name: typed.select(F.col(spec.stream).alias(f"_s{name}"), F.col(spec.idx).alias(f"_i{name}"), *(F.col(c).alias(f"{name}_{c}") for c in spec.v))
    for name in ("a", "b"):
        links = links.join(side(name), F.col(spec.stream).eqNullSafe(F.col(f"_s{name}")) & (F.col(name) == F.col(f"_i{name}")))
    cosine = P.edge_cosine(spec.velocity("a_"), spec.velocity("b_"))
    out = links.select(spec.stream, "a", "b", "distance", cosine.alias("cosine")).withColumn("weight", F.col("distance") + F.lit(float(velocity_weight)) * (F.lit(1.0) - F.col("cosine")))
    out = out.where(F.col("distance") <= F.lit(float(jump_cap)))
    return out if sever_cos_threshold is None else out.where(F.col("cosine") >= F.lit(float(sever_cos_threshold)))
