"""Ordering by a greedy walk along the velocities, one curve at a time.

From the start, the walk goes to the unvisited point of least metric distance, the lesser idx among equals.  It ends

- at a point of ``terminate`` (which is visited), or when ``n_max`` points are visited, the start included;
- when the nearest unvisited point, or the chosen one, is farther than ``max_dist`` in position;
- when no candidate is left.

A curve's walk is sequential by nature, so one task walks one curve; curves are spread over the cluster.  A step is a
best-first search of a tree of the points that are left: boxes whose bound of the metric is beyond the best so far aren't
opened, and visited points leave the tree.
Defined cases: null or non-finite components, a repeated idx, an unknown start and max_dist <= 0 are errors.
"""

from __future__ import annotations

import heapq
import warnings
from abc import ABC, abstractmethod
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.functions.metrics import AlignedMomentum, Bound, FullPhaseSpace, Metric, lengths
from arcwright.functions.units import Quantity, UnitSystem, plain, stripped
from arcwright.spec import Spec
from arcwright.tables import stored

from .keyed import key_of, stream_of
from .ranges import ranked
from .results import Ordering


class Strategy(ABC):
    """Which points a step of the walk may go to."""

    def start(self, q: np.ndarray):
        """State made once for a curve."""
        return None

    @abstractmethod
    def candidates(self, state, current: int, q: np.ndarray) -> np.ndarray | None:
        """Rows that may follow; None for all."""


class BruteForce(Strategy):
    def candidates(self, state, current, q):
        return None


class KDTree:
    """Points of a curve, halved at the median of their widest component until LEAF are left."""

    LEAF = 16

    def __init__(self, q: np.ndarray) -> None:
        self.q, self.root = q, self._node(q, np.arange(len(q)))

    @classmethod
    def _node(cls, q: np.ndarray, rows: np.ndarray):
        low, high = q[rows].min(axis=0), q[rows].max(axis=0)
        if len(rows) <= cls.LEAF or not (high > low).any():
            return low, high, rows, None, None
        by = rows[np.argsort(q[rows, np.argmax(high - low)], kind="stable")]
        half = len(by) // 2
        return low, high, None, cls._node(q, by[:half]), cls._node(q, by[half:])

    def query(self, at: np.ndarray, k: int) -> np.ndarray:
        """The k nearest rows, by distance, the lesser row among equals."""
        best, far = [(0.0, 0, self.root)], np.inf
        rows, dist, number = np.zeros(0, np.int64), np.zeros(0), 0
        while best:
            reach, _, (_, _, own, left, right) = heapq.heappop(best)
            if reach > far:
                break
            if own is None:
                for child in (left, right):
                    number += 1
                    gap = np.maximum(0.0, np.maximum(child[0] - at, at - child[1]))
                    heapq.heappush(best, (float(np.sqrt((gap * gap).sum())) * (1 - 1e-12), number, child))
                continue
            rows, dist = np.concatenate([rows, own]), np.concatenate([dist, lengths(self.q[own] - at)])
            keep = np.lexsort((rows, dist))[:k]
            rows, dist = rows[keep], dist[keep]
            far = dist[-1] if len(rows) == k else np.inf
        return rows


class Left:
    """A tree of the points that a walk has not visited, with boxes in position and velocity.

    Points are halved at the median of the component of widest extent, in position or in scaled velocity."""

    LEAF = 24

    def __init__(self, q: np.ndarray, v: np.ndarray, speed: float = 0.0) -> None:
        self.q, self.v = q, v
        self.box, self.child, self.rows, self.n, self.up = [], [], [], [], []
        self.leaf_of = np.zeros(len(q), np.int64)
        w = np.concatenate([q, speed * v], axis=1)
        todo = [(np.arange(len(q)), -1)]
        while todo:
            rows, up = todo.pop()
            node = len(self.n)
            if up >= 0:
                self.child[up] = (*self.child[up], node)
            corner = lambda x, f: tuple(f(x[rows], axis=0).tolist())
            self.box.append((corner(q, np.min), corner(q, np.max), corner(v, np.min), corner(v, np.max)))
            self.child.append(())
            self.rows.append(None)
            self.n.append(len(rows))
            self.up.append(up)
            spread = w[rows].max(axis=0) - w[rows].min(axis=0)
            if len(rows) > self.LEAF and spread.any():
                by = rows[np.argsort(w[rows, np.argmax(spread)], kind="stable")]
                todo += [(np.sort(by[len(by) // 2 :]), node), (np.sort(by[: len(by) // 2]), node)]
            else:
                self.rows[node] = rows
                self.leaf_of[rows] = node

    def remove(self, row: int) -> None:
        node = int(self.leaf_of[row])
        rows = self.rows[node]
        self.rows[node] = rows[rows != row]
        while node >= 0:
            self.n[node] -= 1
            node = self.up[node]

    def nearest(self, metric: Metric, bound: Bound, current: int, scale: float) -> tuple[float, int]:
        """Least metric distance from a row to those that are left, and the least row that has it; -1 without one."""
        q, v, box, child, count = self.q, self.v, self.box, self.child, self.n
        best, found = np.inf, -1
        heap = [(bound(*box[0]), 0)] if count[0] else []
        while heap:
            low, node = heapq.heappop(heap)
            if low > best:
                break
            rows = self.rows[node]
            if rows is None:
                for c in child[node]:
                    if count[c] and (low := bound(*box[c])) <= best:
                        heapq.heappush(heap, (low, c))
                continue
            cost = metric.array(q[current], v[current], q[rows], v[rows], scale)
            i = int(np.argmin(cost))
            if cost[i] < best or (cost[i] == best and rows[i] < found):
                best, found = float(cost[i]), int(rows[i])
        return best, found


@dataclass(frozen=True)
class Nearest(Strategy):
    """The k nearest other points in position, visited or not, by a tree that is built once for a curve."""

    k: int = 50

    def start(self, q):
        return KDTree(q)

    def candidates(self, state, current, q):
        found = state.query(q[current], min(self.k + 1, len(q)))
        return found[found != current][: self.k]


@dataclass(frozen=True)
class WalkConfig:
    metric: Metric = field(default_factory=AlignedMomentum)
    strategy: Strategy = field(default_factory=BruteForce)


def steps(q, v, start: int, config: WalkConfig, scale: float, max_dist: float, terminate: set[int], n_max: int) -> list[int]:
    """Rows in the order in which one walk visits them.

    The chosen point is never nearer than the nearest one that is left, so its distance alone decides by max_dist."""
    metric, strategy = config.metric, config.strategy
    state = strategy.start(q)
    left = np.ones(len(q), bool)
    searched = isinstance(strategy, BruteForce) and metric.bound(q[start], v[start], scale) is not None
    tree = Left(q, v, abs(scale) if isinstance(metric, FullPhaseSpace) else 0.0) if searched else None
    path, current = [start], start
    left[start] = False
    if tree:
        tree.remove(start)
    while len(path) < n_max and current not in terminate:
        if tree:
            cost, best = tree.nearest(metric, metric.bound(q[current], v[current], scale), current, scale)
        else:
            some = strategy.candidates(state, current, q)
            rows = np.flatnonzero(left) if some is None else np.sort(some[left[some]])
            each = metric.array(q[current], v[current], q[rows], v[rows], scale)
            i = int(np.argmin(each)) if len(rows) else -1
            cost, best = (float(each[i]), int(rows[i])) if len(rows) else (np.inf, -1)
        if best < 0 or not np.isfinite(cost) or lengths(q[best : best + 1] - q[current])[0] > max_dist:
            break
        path.append(best)
        left[best] = False
        if tree:
            tree.remove(best)
        current = best
    return path


def combined(forward: list[int], backward: list[int]) -> list[int]:
    """The backward walk reversed, then the forward walk; a point keeps its first place."""
    return list(dict.fromkeys([*backward[:0:-1], *forward]))


class Orderer(ABC):
    @abstractmethod
    def order(self, df: DataFrame, spec: Spec) -> DataFrame:
        """stream, idx, ord of all rows: ord counts visits from 0, and is null for skipped points."""

    #: Range of the coordinate along the order.
    gamma_range: tuple[float, float] = (0.0, 1.0)

    def result(self, df: DataFrame, spec: Spec) -> Ordering:
        """The order with its points and its range, as an object that interpolates."""
        return Ordering(df, self.order(df, spec), spec, self.gamma_range)


def checked(pdf: pd.DataFrame, spec: Spec) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(spec.idx, kind="stable").reset_index(drop=True)
    q, v = pdf[list(spec.q)].to_numpy(float), pdf[list(spec.v)].to_numpy(float)
    if not (np.isfinite(q).all() and np.isfinite(v).all()):
        raise ValueError("components must be finite numbers")
    if pdf[spec.idx].duplicated().any() or pdf[spec.idx].isna().any():
        raise ValueError("idx must be unique within a stream, and not null")
    return pdf, q, v


def placed(pdf: pd.DataFrame, spec: Spec, path: list[int]) -> pd.DataFrame:
    ord_ = pd.array([pd.NA] * len(pdf), dtype="Int64")
    ord_[path] = np.arange(len(path))
    return pd.DataFrame({spec.stream: pdf[spec.stream], spec.idx: pdf[spec.idx], "ord": ord_})


def ordered_schema(df: DataFrame, spec: Spec) -> str:
    return f"`{spec.stream}` {df.schema[spec.stream].dataType.simpleString()}, `{spec.idx}` long, ord long"


@dataclass(frozen=True)
class LocalFlowOrderer(Orderer):
    """start and terminate are values of idx; without a start, the walk begins at the least idx of each curve."""

    metric_scale: float | Quantity = 1.0
    config: WalkConfig = field(default_factory=WalkConfig)
    start: int | None = None
    direction: str = "forward"
    max_dist: float | Quantity = float("inf")
    terminate: frozenset[int] = frozenset()
    n_max: int | None = None

    def __post_init__(self) -> None:
        if self.direction not in ("forward", "backward", "both"):
            raise ValueError("direction must be forward, backward or both")
        if not isinstance(self.max_dist, Quantity) and not self.max_dist > 0:
            raise ValueError("max_dist must be positive")

    @property
    def gamma_range(self) -> tuple[float, float]:
        return {"forward": (0.0, 1.0), "backward": (-1.0, 0.0), "both": (-1.0, 1.0)}[self.direction]

    def order(self, df: DataFrame, spec: Spec) -> DataFrame:
        config, scale, far, direction = self.config, float(self.metric_scale), float(self.max_dist), self.direction
        start, terminate, n_max = self.start, self.terminate, self.n_max

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, q, v = checked(pdf, spec)
            row = {int(i): r for r, i in enumerate(pdf[spec.idx])}
            if start is not None and start not in row:
                raise ValueError(f"start {start} is out of bounds")
            first = 0 if start is None else row[start]
            stop = {row[i] for i in terminate if i in row}
            walk = lambda sign: steps(q, sign * v, first, config, scale, far, stop, len(q) if n_max is None else n_max)
            path = combined(walk(1.0), walk(-1.0)) if direction == "both" else walk(-1.0 if direction == "backward" else 1.0)
            return placed(pdf, spec, path)

        return spec.typed(df).groupBy(spec.stream).applyInPandas(run, ordered_schema(df, spec))


def order(df: DataFrame, spec: Spec, orderer: Orderer | None = None, *, units: UnitSystem | None = None) -> DataFrame:
    """stream, idx, ord of each row, by the orderer, or by a walk of defaults.

    Components with units are converted to the unit system first; then a walk's max_dist must be a Quantity of length, and
    metric_scale one of length, or of time for the full phase-space metric; a spanning tree's jump_cap and velocity_weight
    must be Quantities of length (an infinite cap and a weight of 0 need no unit).
    """
    orderer = LocalFlowOrderer() if orderer is None else orderer
    if any("unit" in df.schema[c].metadata for c in (*spec.q, *spec.v)) or units is not None:
        df = stripped(df, spec, units)
        if isinstance(orderer, LocalFlowOrderer):
            scale = units.time if isinstance(orderer.config.metric, FullPhaseSpace) else units.length
            far = orderer.max_dist
            far = far if not isinstance(far, Quantity) and np.isinf(far) else plain(far, units.length)
            orderer = replace(orderer, metric_scale=plain(orderer.metric_scale, scale), max_dist=far)
        elif hasattr(orderer, "jump_cap"):
            cap, weight = orderer.jump_cap, orderer.velocity_weight
            orderer = replace(orderer, jump_cap=cap if not isinstance(cap, Quantity) and np.isinf(cap) else plain(cap, units.length), velocity_weight=0.0 if weight == 0 else plain(weight, units.length))
    return orderer.order(df, spec)


def walk_local_flow(df: DataFrame, spec: Spec, **options) -> DataFrame:
    """The old name of ``order`` with a LocalFlowOrderer."""
    warnings.warn("use order(df, spec, LocalFlowOrderer(...))", DeprecationWarning, stacklevel=2)
    return order(df, spec, LocalFlowOrderer(**options))


def combine_results(forward: DataFrame, backward: DataFrame, spec: Spec) -> DataFrame:
    """stream, idx, ord of two walks from one start over the same rows: the backward one reversed, then the forward one.

    A row that only one of them has is an error, and so are different components, where both have columns for them."""
    key = [spec.stream, spec.idx]
    carried = [c for c in (*spec.q, *spec.v) if c in forward.columns and c in backward.columns]
    f = forward.select(*(F.col(c).alias(f"_f{i}") for i, c in enumerate([*key, "ord", *carried])), F.lit(1).alias("_f"))
    b = backward.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate([*key, "ord", *carried])), F.lit(1).alias("_b"))
    both = f.join(b, F.col("_f0").eqNullSafe(F.col("_b0")) & F.col("_f1").eqNullSafe(F.col("_b1")), "full")
    same = F.col("_f").isNotNull() & F.col("_b").isNotNull()
    for i in range(3, 3 + len(carried)):
        same &= F.col(f"_f{i}").eqNullSafe(F.col(f"_b{i}"))
    # the backward walk but its start, reversed, comes first: places below 0
    place = F.when(~same, F.raise_error(F.lit("both walks must have the same rows and components")).cast("long")).when(F.col("_b2") > 0, -F.col("_b2")).otherwise(F.col("_f2"))
    kind = forward.schema[spec.stream].dataType
    rows = stored(both.select(key_of(F.col("_f0")).alias("_k"), F.col("_f1").alias("_i"), place.alias("_p")), "walks-combined")
    placed_rows = ranked(rows.where("_p is not null"), "_k", ["_p", "_i"], "ord").select("_k", "_i", "ord")
    out = placed_rows.unionByName(rows.where("_p is null").select("_k", "_i", F.lit(None).cast("long").alias("ord")))
    return out.select(stream_of(F.col("_k"), kind).alias(spec.stream), F.col("_i").alias(spec.idx), "ord")


def combine(forward: Ordering, backward: Ordering) -> Ordering:
    """Two results from one start over the same points, as one; the range goes from the backward one's to the forward one's."""
    spec = forward.spec
    with_points = lambda r: r.order.join(spec.typed(r.points).withColumnsRenamed({spec.stream: "_s", spec.idx: "_i"}), F.col(spec.stream).eqNullSafe(F.col("_s")) & (F.col(spec.idx) == F.col("_i")), "left").drop("_s", "_i")
    order = combine_results(with_points(forward), with_points(backward), spec)
    return Ordering(forward.points, order, spec, (backward.gamma_range[0], forward.gamma_range[1]))
