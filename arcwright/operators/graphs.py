"""Components and tours of trees, of edge tables of any size, by joins.

Every step is a join or an aggregate, written to the shared folder, and the number of steps grows with the logarithm of
the longest chain.  A node is a struct (_k, _i): the key of its stream, and its idx.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.tables import discard, stored

from .keyed import join_common
from .ranges import Ranges

#: Rows of links or arcs that a task takes at most.
BOUND = 1 << 19


def _replaced(old: DataFrame | None, new: DataFrame, name: str) -> DataFrame:
    out = stored(new, name)
    if old is not None:
        discard(old)
    return out


def _large(e: DataFrame, total: int) -> DataFrame:
    """Larger neighbours of each node move to its least neighbour, itself included."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
    return join_common(both, least, "a", 2 * total).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame, total: int) -> DataFrame:
    """A node and its lesser neighbours move to the least of these (a > b in each edge)."""
    least = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_common(e, least, "a", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """id, component: the least node that each node of an edge (a, b) between different nodes reaches, by alternating
    contractions to stars."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "graph-edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        grown = stored(_large(e, now[0]).distinct(), "graph-stars")
        e = _replaced(e, _small(grown, now[0]), "graph-edges")
        discard(grown)
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def roots(links: DataFrame) -> DataFrame:
    """c, root of links (c, p) in which each chain ends in a pair that point at each other: the lesser of the pair is the
    root.  A round joins each pointer to the one it points at, so chains halve."""
    to = lambda t: t.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
    at = links.join(to(links), F.col("p") == F.col("_c"))
    at = stored(at.select("c", F.when((F.col("_p") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")), "graph-roots")
    while True:
        new = stored(at.join(to(at), F.col("p") == F.col("_c")).select("c", F.col("_p").alias("p"), (F.col("_p") != F.col("p")).alias("moved")), "graph-roots")
        moved = not new.where("moved").isEmpty()
        discard(at)
        at = new
        if not moved:
            return at.select("c", F.col("p").alias("root"))


def _chains(t: pa.Table) -> pa.Table:
    """Arcs to the nodes of a block as chains in the order of the walk: hu, hv is the first arc of an arc's chain, off its
    number in it; the last arc of a chain has n, its length, and the arc that the walk goes on with outside."""
    u, v, root = t.column("u").to_numpy(), t.column("v").to_numpy(), t.column("root")[0].as_py()
    order = np.lexsort((u, v))
    u, v, n = u[order], v[order], len(order)
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    end = np.concatenate([start[1:], [n]]) - 1
    to = np.concatenate([u[1:], u[:1]])
    to[end] = u[start]  # from (u, v) the walk goes on to the neighbour after u
    over = np.full(n, False)
    over[end] = v[end] == root
    nodes = np.unique(np.concatenate([u, v]))
    code = lambda a, b: np.searchsorted(nodes, b) * len(nodes) + np.searchsorted(nodes, a)
    arcs, want = code(u, v), code(v, to)
    at = np.minimum(np.searchsorted(arcs, want), n - 1)
    inside = (arcs[at] == want) & ~over
    after, head, off = np.where(inside, at, -1).tolist(), [-1] * n, [0] * n
    begins = np.full(n, True)
    begins[at[inside]] = False
    for h in np.flatnonzero(begins).tolist():
        i, k = h, 0
        while i >= 0:
            head[i], off[i] = h, k
            i, k = after[i], k + 1
    head, off = np.array(head), np.array(off, np.int64)
    if (head < 0).any():
        raise ValueError("the edges of a stream aren't one tree")
    columns = [u, v, u[head], v[head], off]
    rest = [pa.array(off + 1, mask=inside), pa.array(v, mask=inside | over), pa.array(to, mask=inside | over)]
    return pa.Table.from_arrays([t.column("_k"), *map(pa.array, columns), *rest], ["_k", "u", "v", "hu", "hv", "off", "n", "nu", "nv"])


def _in_a_row(t: pa.Table) -> pa.Table:
    """The place of the first arc of each chain of a stream."""
    hu, hv, n, nu, nv = (t.column(c).to_pylist() for c in ("hu", "hv", "n", "nu", "nv"))
    row = {a: i for i, a in enumerate(zip(hu, hv, strict=True))}
    after = [None if a is None else row[a, b] for a, b in zip(nu, nv, strict=True)]
    base, total = [0] * len(n), 0
    i = next(iter(set(range(len(n))) - set(after)))
    while i is not None:
        base[i], total = total, total + n[i]
        i = after[i]
    return pa.Table.from_arrays([t.column("_k"), t.column("hu"), t.column("hv"), pa.array(base, pa.int64())], ["_k", "hu", "hv", "base"])


def _placed(chains: DataFrame, arcs: DataFrame) -> DataFrame:
    """_k, hu, hv, base: the place of the first arc of each chain.  A task takes the chains of a stream, which has fewer of
    them the more of its edges lie within blocks; where they are too many, pointers are doubled by joins."""
    most = chains.groupBy("_k").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    if most <= BOUND:
        return chains.groupBy("_k").applyInArrow(_in_a_row, "_k string, hu long, hv long, base long")
    arc = lambda a, b: F.when(F.col(a).isNotNull(), F.struct(F.col("_k"), F.col(a).alias("u"), F.col(b).alias("v")))
    at = stored(chains.select(arc("hu", "hv").alias("id"), arc("nu", "nv").alias("to"), F.col("n").alias("left")), "tour-places")
    while not at.where("to is not null").isEmpty():
        further = at.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"))
        going = at.where("to is not null").join(further, "to").select("id", F.col("_to").alias("to"), (F.col("left") + F.col("_left")).alias("left"))
        at = _replaced(at, going.unionByName(at.where("to is null")), "tour-places")
    sizes = arcs.groupBy("_k").agg(F.count("*").alias("_all"), F.count("*").alias("n"))
    rows = at.select("id._k", F.col("id.u").alias("hu"), F.col("id.v").alias("hv"), "left")
    return join_common(rows, sizes, "_k", arcs.count()).select("_k", "hu", "hv", (F.col("_all") - F.col("left")).alias("base"))


def tour(tree: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """_k, lo, hi, w, p, q of the edges of trees, one to a stream (_k, lo, hi, w): their places in a walk around the tree
    that goes along each edge in both directions, from lo to hi at p and from hi to lo at q, counted from 0.

    The walk leaves a node by the neighbour after the one it came from; it begins at the least node.  A task takes the arcs
    to the nodes of a block (``at``: _k, _i, _x), of BOUND at most but for a node's own, and makes them chains; places come
    from the lengths of chains."""
    ways = tree.select("_k", F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(tree.select("_k", F.col("hi").alias("u"), F.col("lo").alias("v")))
    of = at.select("_k", F.col("_i").alias("v"), "_x") if at is not None else None
    ways = stored(ways.withColumn("_x", F.lit(0).cast("long")) if of is None else ways.join(of, ["_k", "v"]), "tour-ways")
    sizes = ways.groupBy("_k", "_x").agg(F.ceil(F.count("*") / BOUND).alias("_parts"), F.min("u").alias("_least"))
    root = sizes.groupBy("_k").agg(F.min("_least").alias("root"))
    blocks = stored(sizes.select("_k", "_x", "_parts").join(root, "_k"), "tour-blocks")
    ways = ways.join(F.broadcast(blocks), ["_k", "_x"]).withColumn("_part", F.pmod(F.xxhash64("v"), F.col("_parts")))
    kinds = "_k string, u long, v long, hu long, hv long, off long, n long, nu long, nv long"
    arcs = stored(ways.groupBy("_k", "_x", "_part").applyInArrow(_chains, kinds), "tour-arcs")
    chains = arcs.where("n is not null").select("_k", "hu", "hv", "n", "nu", "nv")
    placed = arcs.select("_k", "u", "v", "hu", "hv", "off").join(_placed(chains, arcs), ["_k", "hu", "hv"])
    way = lambda low: F.min(F.when((F.col("u") < F.col("v")) == low, F.col("base") + F.col("off")))
    edges = placed.groupBy("_k", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(way(True).alias("p"), way(False).alias("q"))
    return stored(edges.join(tree, ["_k", "lo", "hi"]).select("_k", "lo", "hi", "w", "p", "q"), "tour-edges")


def rooted(walked: DataFrame, roots: DataFrame) -> DataFrame:
    """_k, child, parent, w, down, up of the edges of a tour, with the tree of each stream hung up at its root (_k, root):
    places at which the walk goes down to the child and comes back, counted from the root."""
    out = lambda node, place: walked.select("_k", F.col(node).alias("root"), F.col(place).alias("_from"))
    leaving = out("lo", "p").unionByName(out("hi", "q"))
    begin = leaving.join(roots, ["_k", "root"]).groupBy("_k").agg(F.min("_from").alias("_from"))
    sizes = walked.groupBy("_k").agg(F.count("*").alias("n"))
    begin = begin.join(sizes, "_k").select("_k", "_from", F.col("n").alias("_m"), "n")
    e = join_common(walked, begin, "_k", walked.count())
    e = e.withColumns({x: F.pmod(F.col(x) - F.col("_from"), 2 * F.col("_m")) for x in ("p", "q")})
    forth = F.col("p") < F.col("q")
    pick = lambda a, b: F.when(forth, F.col(a)).otherwise(F.col(b))
    return e.select("_k", pick("hi", "lo").alias("child"), pick("lo", "hi").alias("parent"), "w", F.least("p", "q").alias("down"), F.greatest("p", "q").alias("up"))


def distances(hung: DataFrame) -> DataFrame:
    """_k, child, down, up, d: the distance of each node from the root, but the root, over a power of two of its stream's.

    Sums over the walk, down with the weight and back without it, in decimals of weights over a power of two of the
    largest, so that what comes back is exactly what went, and equal sums are equal."""
    top = hung.groupBy("_k").agg(F.max("w").alias("_top"), F.count("*").alias("n"))
    unit = F.when(F.col("_top") > 0, F.pow(F.lit(2.0), F.floor(F.log2("_top")))).otherwise(F.lit(1.0))
    e = join_common(hung, top.select("_k", unit.alias("_unit"), "n"), "_k", hung.count())
    e = e.withColumn("_w", (F.col("w") / F.col("_unit")).cast("decimal(38,25)"))
    step = F.explode(F.array(F.struct(F.col("down").alias("at"), F.col("_w").alias("by"), F.lit(True).alias("goes")), F.struct(F.col("up").alias("at"), (-F.col("_w")).alias("by"), F.lit(False).alias("goes"))))
    steps = e.select("_k", "child", "down", "up", step.alias("s")).select("_k", "child", "down", "up", "s.*")
    summed = Ranges(steps, "_k", ["at"]).running({"d": F.col("by")}).rows().where("goes")
    return summed.select("_k", "child", "down", "up", "d")
