"""Ordering along the backbone of a minimum spanning tree of nearest-neighbour links.

Links, their weights and the cuts are made in the cluster (``neighbors.edges``).  The tree of a curve of up to ``at_once``
points is walked in one task; those of larger curves go through ``backbone``, by joins, aggregates and blocks of points.
Both give the same trees, pieces, paths and orders.

Defined cases: a curve under two points is its own order; links between coinciding points have weight 0 and count; among
equal weights the lesser (a, b) goes first into the tree; the direction of the order is arbitrary unless
orient_by_velocity; a curve without links falls into as many components as points.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arcwright.functions.metrics import lengths
from arcwright.functions.units import Quantity
from arcwright.spec import Spec
from arcwright.tables import scratch, stored

from . import backbone as spread
from .keyed import by_size, stream_of
from .neighbors import distances, edges
from .results import Ordering
from .walk import Orderer, checked, ordered_schema, placed

#: Distances computed at once in a task.
BLOCK = 1 << 20
#: A link is cut at twice the median at least; pieces under a hundredth of the points are small.
MIN_RATIO, SMALL_SHARE = 2.0, 0.01
#: Curves in pieces that a warning names.
TOLD = 20


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each point's component."""
    up = np.arange(n)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return np.array([root(i) for i in range(n)], np.int64)


def spanning_tree(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the links of a minimum spanning forest."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    chosen = []
    for e in np.lexsort((b, a, w)).tolist():
        i, j = root(int(a[e])), root(int(b[e]))
        if i != j:
            up[j] = i
            chosen.append(e)
    return np.array(chosen, np.int64)


def clip(q: np.ndarray, a: np.ndarray, b: np.ndarray, nodes: np.ndarray, sigma: float, most: int) -> np.ndarray:
    """Points left after small pieces behind unusually long links of the tree are taken off, again and again."""
    for _ in range(most):
        inside = np.isin(a, nodes) & np.isin(b, nodes)
        i, j = a[inside], b[inside]
        if not len(i):
            break
        with np.errstate(divide="ignore"):
            long = np.log(np.maximum(lengths(q[i] - q[j]), np.finfo(float).tiny))
        mid = np.median(long)
        cut = long > mid + max(sigma * 1.4826 * np.median(np.abs(long - mid)), np.log(MIN_RATIO))
        if not cut.any():
            break
        label = components(len(q), i[~cut], j[~cut])[nodes]
        _, inverse, size = np.unique(label, return_inverse=True, return_counts=True)
        small = size[inverse] < max(2, int(np.ceil(SMALL_SHARE * len(nodes))))
        if not small.any():
            break
        nodes = nodes[~small]
    return nodes


def _from(source: int, n: int, near: list[list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray]:
    """Distances over the tree and predecessors."""
    d, before = np.full(n, np.inf), np.full(n, -1)
    d[source] = 0.0
    stack = [source]
    while stack:
        i = stack.pop()
        for j, w in near[i]:
            if d[j] == np.inf:
                d[j], before[j] = d[i] + w, i
                stack.append(j)
    return d, before


def backbone(q: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, nodes: np.ndarray, orient: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, and the rows of the longest path of the tree: each point counts at its nearest vertex of the path."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(len(q))]
    inside = np.full(len(q), False)
    inside[nodes] = True
    for i, j, x in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        if inside[i] and inside[j]:
            near[i].append((j, x))
            near[j].append((i, x))
    far = lambda d: int(nodes[np.argmax(np.where(np.isfinite(d[nodes]), d[nodes], -1))])
    one = far(_from(int(nodes[0]), len(q), near)[0])
    d, before = _from(one, len(q), near)
    path = [far(d)]
    while before[path[-1]] >= 0:
        path.append(int(before[path[-1]]))
    path = np.array(path[::-1], np.int64)
    if orient and len(path) > 1 and (np.diff(q[path], axis=0) * (v[path[1:]] + v[path[:-1]]) / 2).sum() < 0:
        path = path[::-1]
    s = np.concatenate([[0.0], np.cumsum(lengths(np.diff(q[path], axis=0)))]) if len(path) > 1 else np.zeros(1)
    closest = [distances(q[part], q[path]).argmin(axis=1) for part in np.array_split(nodes, len(nodes) * len(path) // BLOCK + 1)]
    at = s[np.concatenate(closest)]
    return nodes[np.argsort(at, kind="stable")], path


@dataclass(frozen=True)
class MSTOrderer(Orderer):
    k: int = 10
    jump_cap: float | Quantity = 3.0
    velocity_weight: float | Quantity = 0.0
    sever_cos_threshold: float | None = None
    orient_by_velocity: bool = False
    on_disconnected: str = "raise"
    edge_clip_sigma: float | None = None
    edge_clip_max_iters: int = 5
    #: Points of a curve that one task takes.
    at_once: int = 200_000

    gamma_range = (-1.0, 1.0)

    def __post_init__(self) -> None:
        number = lambda x: x.value if isinstance(x, Quantity) else x
        if self.k < 1 or not number(self.jump_cap) > 0 or number(self.velocity_weight) < 0 or self.edge_clip_max_iters < 1:
            raise ValueError("k, jump_cap and edge_clip_max_iters must be positive, velocity_weight not negative")
        if self.sever_cos_threshold is not None and not -1 <= self.sever_cos_threshold <= 1:
            raise ValueError("sever_cos_threshold must be in [-1, 1]")
        if self.on_disconnected not in ("raise", "warn", "largest"):
            raise ValueError("on_disconnected must be raise, warn or largest")
        if self.edge_clip_sigma is not None and not self.edge_clip_sigma > 0:
            raise ValueError("edge_clip_sigma must be positive")

    def links(self, df: DataFrame, spec: Spec) -> DataFrame:
        return edges(df, spec, self.k, float(self.velocity_weight), float(self.jump_cap), self.sever_cos_threshold)

    def _both(self, df: DataFrame, spec: Spec, per_curve, spread_out) -> DataFrame:
        """What per_curve gives for small curves, and spread_out for large ones."""
        small, large = by_size(df, spec.stream, self.at_once)
        if large is None:
            return per_curve(small)
        return spread_out(large) if small is None else per_curve(small).unionByName(spread_out(large))

    def _placed(self, rows: DataFrame, df: DataFrame, spec: Spec, *columns) -> DataFrame:
        """Rows of keys (_k, _i) as rows of streams."""
        return rows.select(stream_of(F.col("_k"), df.schema[spec.stream].dataType).alias(spec.stream), *columns)

    def _per_curve(self, df: DataFrame, spec: Spec, finish, schema: str, links: DataFrame | None = None) -> DataFrame:
        links = self.links(df, spec) if links is None else links

        names = StructType.fromDDL(schema).names

        def run(points: pd.DataFrame, linked: pd.DataFrame) -> pd.DataFrame:
            if not len(points):  # links of a curve that isn't asked for
                return pd.DataFrame(columns=names, dtype=object)
            pdf, q, v = checked(points, spec)
            ids = pdf[spec.idx].to_numpy()
            a, b = np.searchsorted(ids, linked["a"].to_numpy()), np.searchsorted(ids, linked["b"].to_numpy())
            return finish(pdf, q, v, a, b, linked["weight"].to_numpy(float))

        return spec.typed(df).groupBy(spec.stream).cogroup(links.groupBy(spec.stream)).applyInPandas(run, schema)

    def _settled(self, q, v, a, b, w) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        if n < 2:
            return np.arange(n), np.arange(n)
        tree = spanning_tree(n, a, b, w)
        a, b, w = a[tree], b[tree], w[tree]
        label = components(n, a, b)
        nodes = np.arange(n)
        kinds, sizes = np.unique(label, return_counts=True)
        if len(kinds) > 1:
            says = f"the links of {n} points fall into {len(kinds)} components; raise k or jump_cap"
            if self.on_disconnected == "raise":
                raise ValueError(says)
            nodes = np.flatnonzero(label == kinds[np.argmax(sizes)])
        if self.edge_clip_sigma is not None:
            left = clip(q, a, b, nodes, self.edge_clip_sigma, self.edge_clip_max_iters)
            nodes = left if len(left) else nodes
        return backbone(q, v, a, b, w, nodes, self.orient_by_velocity)

    def settle(self, df: DataFrame, spec: Spec) -> DataFrame:
        """stream, idx, ord, vertex of all rows: the order, and the place on the backbone of its vertices, of one run.

        With on_disconnected "warn", links are made at once, and curves that fall into pieces are told by a warning."""
        links = None
        if self.on_disconnected == "warn":
            links = stored(self.links(df, spec), "mst-links")
            pieces = self.components(df, spec, links).groupBy(spec.stream).agg(F.countDistinct("component").alias("n")).where("n > 1")
            if some := pieces.orderBy(F.desc("n")).limit(TOLD).collect():
                says = ", ".join(f"{r[0]} into {r[1]}" for r in some)
                warnings.warn(f"links of curves fall into components ({says}); raise k or jump_cap", stacklevel=2)
        settled = self._settled

        def finish(pdf, q, v, a, b, w):
            order, path = settled(q, v, a, b, w)
            return placed(pdf, spec, order.tolist()).assign(vertex=placed(pdf, spec, path.tolist())["ord"])

        def spread_out(rows: DataFrame) -> DataFrame:
            with scratch(df.sparkSession) as keep:
                own = spread.keyed_links(self.links(rows, spec) if links is None else links, spec)
                points = spread.keyed_points(rows, spec)
                own = own if links is None else own.join(points.select("_k").distinct(), "_k", "left_semi")
                found = spread.settle(points, len(spec.q), own, on_disconnected=self.on_disconnected, sigma=self.edge_clip_sigma, rounds=self.edge_clip_max_iters, orient=self.orient_by_velocity, least_ratio=MIN_RATIO, small_share=SMALL_SHARE)
                return keep(self._placed(found, df, spec, F.col("_i").alias(spec.idx), "ord", "vertex"), "mst-settled")

        per_curve = lambda rows: self._per_curve(rows, spec, finish, ordered_schema(df, spec) + ", vertex long", links)
        return self._both(df, spec, per_curve, spread_out)

    def order(self, df: DataFrame, spec: Spec) -> DataFrame:
        return self.settle(df, spec).drop("vertex")

    def backbone(self, df: DataFrame, spec: Spec) -> DataFrame:
        """stream, idx, ord of the vertices of each curve's backbone."""
        return self.settle(df, spec).where("vertex is not null").select(spec.stream, spec.idx, F.col("vertex").alias("ord"))

    def result(self, df: DataFrame, spec: Spec) -> Ordering:
        both = stored(self.settle(df, spec), "mst-result")
        vertices = both.where("vertex is not null").select(spec.stream, spec.idx, F.col("vertex").alias("ord"))
        return Ordering(df, both.drop("vertex"), spec, self.gamma_range, vertices)

    def tree(self, df: DataFrame, spec: Spec) -> DataFrame:
        """stream, a, b, weight of the links of each curve's minimum spanning forest."""

        def finish(pdf, q, v, a, b, w):
            tree, ids = spanning_tree(len(q), a, b, w), pdf[spec.idx].to_numpy()
            return pd.DataFrame({spec.stream: pdf[spec.stream].iloc[np.zeros(len(tree), int)].reset_index(drop=True), "a": ids[a[tree]].astype("int64"), "b": ids[b[tree]].astype("int64"), "weight": w[tree].astype(float)})

        def spread_out(rows: DataFrame) -> DataFrame:
            with scratch(df.sparkSession) as keep:
                at = spread.blocks(spread.keyed_points(rows, spec), len(spec.q))
                found = spread.forest(spread.keyed_links(self.links(rows, spec), spec), at)
                return keep(self._placed(found, df, spec, F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("w").alias("weight")), "mst-tree")

        kind = df.schema[spec.stream].dataType.simpleString()
        return self._both(df, spec, lambda rows: self._per_curve(rows, spec, finish, f"`{spec.stream}` {kind}, a long, b long, weight double"), spread_out)

    def components(self, df: DataFrame, spec: Spec, links: DataFrame | None = None) -> DataFrame:
        """stream, idx, component: the least idx that links reach."""

        def finish(pdf, q, v, a, b, w):
            return pd.DataFrame({spec.stream: pdf[spec.stream], spec.idx: pdf[spec.idx], "component": pdf[spec.idx].to_numpy()[components(len(q), a, b)]})

        def spread_out(rows: DataFrame) -> DataFrame:
            with scratch(df.sparkSession) as keep:
                own = spread.keyed_links(self.links(rows, spec) if links is None else links, spec)
                points = spread.keyed_points(rows, spec)
                found = spread.labels(points, own, "a", "b", spread.blocks(points, len(spec.q)))
                return keep(self._placed(found, df, spec, F.col("_i").alias(spec.idx), F.col("c").alias("component")), "mst-components")

        kind = df.schema[spec.stream].dataType.simpleString()
        return self._both(df, spec, lambda rows: self._per_curve(rows, spec, finish, f"`{spec.stream}` {kind}, `{spec.idx}` long, component long", links), spread_out)
