"""Spanning forests and components of links between points, by blocks of points that lie together.

A block is a leaf of a tree of medians (see ``neighbors``), so most links lie within one.  A task takes the links of a
block and contracts what these alone decide; what is left, mostly links between blocks, is taken again by coarser blocks,
which are nodes of the same tree, as far as none has more than graphs.BOUND rows.  Where no coarser ones are left, a round is
made by joins and aggregates instead.  So no task takes more than that, and curves of any size take few rounds.

Links have _k (the stream's key), ca and cb (the components of their ends, by their least members), xa and xb (the blocks
of those components).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.tables import discard, stored

from . import graphs
from .graphs import connected, roots
from .neighbors import _by_key, _trees, _vectors


def blocks(points: DataFrame, names: list[str], most: int | None = None) -> DataFrame:
    """_k, _i, _x: the block of each point, 0 for all of a curve that isn't cut."""
    trees = _trees(points, names, most)
    rows = points.select("_k", "_i", *names)
    if not trees:
        return rows.select("_k", "_i", F.lit(0).cast("long").alias("_x"))
    sent = points.sparkSession.sparkContext.broadcast(trees)

    def place(batches):
        for b in batches:
            q, leaf = _vectors(b, names), np.zeros(b.num_rows, np.int64)
            for key, own in _by_key(b.column("_k")):
                if key in sent.value:
                    leaf[own] = sent.value[key].leaf(q[own])
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_i"), pa.array(leaf)], ["_k", "_i", "_x"])

    return stored(rows.mapInArrow(place, "_k string, _i long, _x long"), "curve-blocks")


class _Sets:
    """Sets of numbers from 0, each known by its least member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> int:
        i, j = min(i, j), max(i, j)
        self.up[j] = i
        return i

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """Members that aren't the least of their sets, and these."""
        least = np.array([self.root(i) for i in range(len(self.up))], np.int64)
        some = np.flatnonzero(least != np.arange(len(least)))
        return some, least[some]


def _contracted(t: pa.Table) -> pa.Table:
    """Links of the forest that a block decides, and the components that these move to others.

    Links are taken by (w, a, b).  The first to leave a component is in the forest; if it leaves the block as well, the
    component is stuck, and grows only by others that aren't."""
    col = lambda n: t.column(n).to_numpy()
    g, a, b, w = col("g"), col("a"), col("b"), col("w")
    here_a, here_b = col("xa") == g, col("xb") == g
    ids = np.unique(np.concatenate([col("ca")[here_a], col("cb")[here_b]]))
    at = lambda c, here: np.where(here, np.searchsorted(ids, c), -1)
    order = np.lexsort((b, a, w))
    sets, stuck, chosen = _Sets(len(ids)), [False] * len(ids), []
    for e, i, j in zip(order.tolist(), at(col("ca"), here_a)[order].tolist(), at(col("cb"), here_b)[order].tolist(), strict=True):
        if i < 0 or j < 0:
            stuck[sets.root(max(i, j))] = True
            continue
        i, j = sets.root(i), sets.root(j)
        if i != j:
            if stuck[i] and stuck[j]:
                continue
            chosen.append(e)
            stuck[sets.join(i, j)] = stuck[i] or stuck[j]
    some, least = sets.moved()
    n, e = len(some), np.array(chosen, np.int64)
    key = pa.array([t.column("_k")[0].as_py()] * (len(e) + n), pa.string())
    columns = [np.repeat([False, True], [len(e), n]), np.concatenate([a[e], ids[some]]), np.concatenate([b[e], ids[least]]), np.concatenate([w[e], np.zeros(n)])]
    return pa.Table.from_arrays([key, *map(pa.array, columns)], ["_k", "moved", "a", "b", "w"])


def _united(t: pa.Table) -> pa.Table:
    """Components of a block that its links move to others."""
    a, b = t.column("ca").to_numpy(), t.column("cb").to_numpy()
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = _Sets(len(ids))
    for i, j in at.reshape(2, -1).T.tolist():
        i, j = sets.root(i), sets.root(j)
        if i != j:
            sets.join(i, j)
    some, least = sets.moved()
    return pa.Table.from_arrays([pa.array([t.column("_k")[0].as_py()] * len(some), pa.string()), pa.array(ids[some]), pa.array(ids[least])], ["_k", "c", "root"])


def _in_blocks(links: DataFrame, at: DataFrame | None) -> DataFrame:
    """Links with the blocks of their ends; without blocks a curve is one."""
    if at is None:
        return links.withColumns({"xa": F.lit(0).cast("long"), "xb": F.lit(0).cast("long")})
    for side in "ab":
        links = links.join(at.select("_k", F.col("_i").alias(f"c{side}"), F.col("_x").alias(f"x{side}")), ["_k", f"c{side}"])
    return links


def _levels(e: DataFrame, first: bool) -> tuple[bool, int, bool]:
    """Whether there are links; the level of the coarsest blocks of up to graphs.BOUND rows, -1 if there are none; of the
    first links, that of the finest blocks; and whether each curve is one block of that level."""
    n = e.select("_k", F.explode(F.array_distinct(F.array("xa", "xb"))).alias("x")).groupBy("_k", "x").agg(F.count("*").alias("n")).toPandas()
    some, best, level, whole = len(n) > 0, -1, 0, False
    while len(n) and n["n"].max() <= graphs.BOUND:
        best, whole = level, not n["x"].any()
        if first or whole:
            break
        level += 1
        n = n.assign(x=n["x"] // 2).groupby(["_k", "x"], as_index=False)["n"].sum()
    return some, best, whole


def _coarse(x: str, level: int) -> Column:
    return F.shiftright(x, level)


def _moved(e: DataFrame, moves: DataFrame, level: int) -> DataFrame:
    """Links with the components that theirs have moved to (_k, c, root, and x where the block is another one); those
    within a component are gone.  Blocks are the least of their level, so that a component has one."""
    for side in "ab":
        c, x = f"c{side}", f"x{side}"
        e = e.join(moves.select("_k", F.col("c").alias(c), F.col("root").alias("_root"), F.col("x").alias("_to")), ["_k", c], "left")
        e = e.withColumns({c: F.coalesce("_root", c), x: F.coalesce("_to", F.shiftleft(_coarse(x, level), level))}).drop("_root", "_to")
    return e.where("ca <> cb")


def _rounds(e: DataFrame, by_blocks: Callable, by_joins: Callable, left: Callable, name: str) -> Iterator[DataFrame]:
    """Rounds over links until none are left; each gives a table of its own."""
    done = -1
    while True:
        some, level, whole = _levels(e, done < 0)
        if not some:
            return
        if level > done:
            made, moves = by_blocks(e, level)
            if whole:  # nothing is left
                discard(e)
                yield made
                return
            moves, done = moves.withColumn("x", F.lit(None).cast("long")), level
        else:
            made, moves = by_joins(e)
        new = stored(left(_moved(e, moves, max(0, done))), name)
        discard(e)
        e = new
        yield made


def forest(links: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """_k, lo, hi, w of the minimum spanning forest of links (_k, a, b, w; a < b), each once; among equal weights the lesser
    (a, b) goes first.  ``at`` says the blocks of the points."""
    columns = ["_k", "a", "b", "w", "ca", "cb", "xa", "xb"]
    e = links.where("a <> b").select("_k", "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    e = stored(_in_blocks(e, at).select(columns), "forest-edges")

    def by_blocks(e: DataFrame, level: int):
        own = e.withColumns({x: _coarse(x, level) for x in ("xa", "xb")})
        own = own.withColumn("g", F.explode(F.array_distinct(F.array("xa", "xb"))))
        out = stored(own.groupBy("_k", "g").applyInArrow(_contracted, "_k string, moved boolean, a long, b long, w double"), "forest-blocks")
        return out.where("not moved").drop("moved"), out.where("moved").select("_k", F.col("a").alias("c"), F.col("b").alias("root"))

    def by_joins(e: DataFrame):
        """Every component takes its first link out, and what these join is contracted."""
        ends = lambda c, x, to: e.select("_k", F.col(c).alias("c"), F.struct("w", "a", "b", F.col(to).alias("to"), F.col(x).alias("x")).alias("y"))
        first = stored(ends("ca", "xa", "cb").unionByName(ends("cb", "xb", "ca")).groupBy("_k", "c").agg(F.min("y").alias("y")), "forest-first")
        node = lambda c: F.struct(F.col("_k"), F.col(c).alias("_i"))
        root = roots(first.select(node("c").alias("c"), node("y.to").alias("p"))).select(F.col("c._k").alias("_k"), F.col("c._i").alias("c"), F.col("root._i").alias("root"))
        moves = root.join(first.select("_k", F.col("c").alias("root"), F.col("y.x").alias("x")), ["_k", "root"])
        return first.select("_k", "y.a", "y.b", "y.w").distinct(), moves

    def left(e: DataFrame) -> DataFrame:
        """Of the links between two components the first."""
        ordered = F.col("ca") < F.col("cb")
        x = F.struct("w", "a", "b", F.when(ordered, F.col("xa")).otherwise(F.col("xb")).alias("xa"), F.when(ordered, F.col("xb")).otherwise(F.col("xa")).alias("xb"))
        return e.groupBy("_k", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(x).alias("x")).select("_k", "x.a", "x.b", "x.w", "ca", "cb", "x.xa", "x.xb")

    chosen = list(_rounds(e, by_blocks, by_joins, left, "forest-edges"))
    found = reduce(DataFrame.unionByName, chosen) if chosen else links.select("_k", "a", "b", "w").limit(0)
    return found.select("_k", F.col("a").alias("lo"), F.col("b").alias("hi"), "w")


def components(nodes: DataFrame, links: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """_k, _i, c of the nodes (_k, _i): the least idx that links (_k, a, b) reach."""
    e = links.where("a <> b").select("_k", F.col("a").alias("ca"), F.col("b").alias("cb"))
    e = stored(_in_blocks(e, at).select("_k", "ca", "cb", "xa", "xb"), "graph-edges")

    def by_blocks(e: DataFrame, level: int):
        inside = e.withColumn("g", _coarse("xa", level)).where(F.col("g") == _coarse("xb", level))
        out = stored(inside.groupBy("_k", "g").applyInArrow(_united, "_k string, c long, root long"), "graph-blocks")
        return out, out

    def by_joins(e: DataFrame):
        node = lambda c: F.struct(F.col("_k"), F.col(c).alias("_i"))
        found = connected(e.select(node("ca").alias("a"), node("cb").alias("b")))
        out = found.select(F.col("id._k").alias("_k"), F.col("id._i").alias("c"), F.col("component._i").alias("root"), F.lit(0).cast("long").alias("x"))
        return out, out

    found = nodes.select("_k", "_i", F.col("_i").alias("c"))
    for moves in _rounds(e, by_blocks, by_joins, DataFrame.distinct, "graph-edges"):
        found = found.join(moves.select("_k", "c", "root"), ["_k", "c"], "left").select("_k", "_i", F.coalesce("root", "c").alias("c"))
    return found
