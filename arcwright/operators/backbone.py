"""Backbones of curves that are larger than a task: the tree, its pieces, its clipping, its longest path and the order
along it, by joins, aggregates and blocks of points (see ``blocks``).  Results are those of ``mst.backbone``, which takes a curve in a task.

Tables have _k (the stream's key) and _i (idx); points also have _q0, .. and _v0, ..  Tables of a row for each curve are
joined by the key with what has many rows for it; such joins are left to Spark, which broadcasts small tables and splits
the partitions of common keys.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.functions import phasespace as P
from arcwright.spec import Spec
from arcwright.tables import stored

from . import blocks as contracted
from .graphs import distances, rooted, tour
from .keyed import join_common, key_of
from .neighbors import nearest_vertex
from .ranges import Ranges, medians, ranked


def keyed_points(df: DataFrame, spec: Spec) -> DataFrame:
    """Points under names of our own; missing or non-finite components and repeated idx are errors."""
    typed = spec.typed(df)
    cols = [*(F.col(c).alias(f"_q{i}") for i, c in enumerate(spec.q)), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(spec.v))]
    out = stored(typed.select(key_of(F.col(spec.stream)).alias("_k"), F.col(spec.idx).alias("_i"), *cols), "curve-points")
    bad = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in out.columns[2:]]
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad |= b
    if not out.where(any_bad).isEmpty():
        raise ValueError("components must be finite numbers")
    if not out.where("_i is null").isEmpty() or not out.groupBy("_k", "_i").count().where("count > 1").isEmpty():
        raise ValueError("idx must be unique within a stream, and not null")
    return out


def keyed_links(links: DataFrame, spec: Spec) -> DataFrame:
    return links.select(key_of(F.col(spec.stream)).alias("_k"), "a", "b", F.col("weight").alias("w"))


def blocks(points: DataFrame, dims: int) -> DataFrame:
    """_k, _i, _x: the block of each point."""
    return contracted.blocks(points, [f"_q{i}" for i in range(dims)])


def forest(links: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """_k, lo, hi, w of the minimum spanning forest of links (_k, a, b, w; a < b)."""
    return stored(contracted.forest(links, at), "curve-forest")


def labels(points: DataFrame, links: DataFrame, lo: str = "lo", hi: str = "hi", at: DataFrame | None = None) -> DataFrame:
    """_k, _i, c of the points: the least idx that links reach."""
    return contracted.components(points.select("_k", "_i"), links.select("_k", F.col(lo).alias("a"), F.col(hi).alias("b")), at)


def _within(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are among the nodes."""
    for end in ("lo", "hi"):
        tree = tree.join(nodes.select("_k", F.col("_i").alias(end)), ["_k", end], "left_semi")
    return tree


def _of_pieces(nodes: DataFrame, pieces: DataFrame, total: int) -> DataFrame:
    """The nodes (_k, _i, c) of some pieces (_k, c, n)."""
    table = pieces.select(F.struct("_k", "c").alias("_p"), "n")
    return join_common(nodes.withColumn("_p", F.struct("_k", "c")), table, "_p", total).select("_k", "_i")


def largest(points: DataFrame, tree: DataFrame, at: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes (_k, _i) of each curve's largest piece, the one of the least idx among equals; and _k, n_pieces."""
    own = stored(labels(points, tree, at=at), "curve-labels")
    pieces = stored(own.groupBy("_k", "c").agg(F.count("*").alias("n")), "curve-pieces")
    best = pieces.groupBy("_k").agg(F.max_by(F.struct("c", "n"), F.struct("n", -F.col("c"))).alias("x")).select("_k", "x.*")
    return stored(_of_pieces(own, best, own.count()), "curve-nodes"), pieces.groupBy("_k").agg(F.count("*").alias("n_pieces"))


def clipped(points: DataFrame, dims: int, tree: DataFrame, nodes: DataFrame, sigma: float, most: int, least_ratio: float, small_share: float, at: DataFrame | None = None) -> DataFrame:
    """The nodes left after small pieces behind unusually long links are taken off, again and again; a curve of which
    nothing would be left keeps its nodes."""
    q = [f"_q{i}" for i in range(dims)]
    side = lambda end: points.select("_k", F.col("_i").alias(end), *(F.col(c).alias(f"{end}{c}") for c in q))
    length = P.euclidean_distance([F.col(f"lo{c}") for c in q], [F.col(f"hi{c}") for c in q])
    measured = tree.join(side("lo"), ["_k", "lo"]).join(side("hi"), ["_k", "hi"]).select("_k", "lo", "hi", F.log(F.greatest(length, F.lit(2.2250738585072014e-308))).alias("x"))
    measured, left = stored(measured, "clip-links"), nodes
    own = measured
    for n in range(most):
        own = stored(_within(own, left), "clip-links") if n else own
        mid = stored(medians(own, "_k", "x", "mid"), "clip-middle")
        away = own.join(mid, "_k").select("_k", "lo", "hi", "x", "mid", F.abs(F.col("x") - F.col("mid")).alias("dev"))
        cut = medians(away, "_k", "dev", "mad").join(mid, "_k").select("_k", (F.col("mid") + F.greatest(F.lit(sigma * 1.4826) * F.col("mad"), F.lit(math.log(least_ratio)))).alias("cut"))
        judged = stored(own.join(cut, "_k").select("_k", "lo", "hi", (F.col("x") > F.col("cut")).alias("long")), "clip-judged")
        touched = judged.where("long").select("_k").distinct()
        pieces = stored(labels(left, judged.where("not long"), at=at), "clip-labels")
        sizes = stored(pieces.groupBy("_k", "c").agg(F.count("*").alias("n")), "clip-sizes")
        whole = sizes.groupBy("_k").agg(F.sum("n").alias("all"))
        small = F.col("touched") & (F.col("n") < F.greatest(F.lit(2), F.ceil(F.lit(small_share) * F.col("all"))))
        sizes = sizes.join(whole, "_k").join(touched.withColumn("touched", F.lit(True)), "_k", "left").withColumn("small", F.coalesce(small, F.lit(False)))
        sizes = stored(sizes.select("_k", "c", "n", "small"), "clip-small")
        if sizes.where("small").isEmpty():
            break
        left = stored(_of_pieces(pieces, sizes.where("not small"), pieces.count()), "clip-nodes")
    some = left.select("_k").distinct()
    return left.unionByName(nodes.join(some, "_k", "left_anti"))


def _of_first(nodes: DataFrame, tree: DataFrame, first: DataFrame, at: DataFrame | None) -> DataFrame:
    """The edges of each curve's piece that holds its first node (_k, root)."""
    own = labels(nodes, tree, at=at).join(first, ["_k"]).where("c = root").select("_k", "_i")
    return stored(_within(tree, stored(own, "path-nodes")), "path-tree")


def longest_path(nodes: DataFrame, tree: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """_k, _i, ord of the vertices of the longest path in the piece of each curve's least node: from the node farthest from
    it to the node farthest from that, the lesser idx among equals.  Clipping may leave several pieces, as what it takes
    off may have joined others."""
    first = stored(nodes.groupBy("_k").agg(F.min("_i").alias("root")), "path-first")
    walked = tour(_of_first(nodes, tree, first, at), at)
    alone = first.join(walked.select("_k").distinct(), "_k", "left_anti")

    def farthest(hung: DataFrame, roots: DataFrame) -> DataFrame:
        d = distances(hung).select("_k", "child", "down", F.col("d").cast("decimal(38,20)").alias("d"))
        own = roots.select("_k", F.col("root").alias("child"), F.lit(-1).cast("long").alias("down"), F.lit(0).cast("decimal(38,20)").alias("d"))
        best = d.unionByName(own).groupBy("_k").agg(F.max_by(F.struct("child", "down"), F.struct("d", -F.col("child"))).alias("x"))
        return stored(best.select("_k", F.col("x.child").alias("root"), "x.down"), "path-ends")

    one = farthest(rooted(walked, first), first.join(alone, "_k", "left_anti")).select("_k", "root")
    hung = stored(rooted(walked, one), "path-hung")
    other = farthest(hung, one)
    sizes = hung.groupBy("_k").agg(F.count("*").alias("n"))
    above = join_common(hung, other.select("_k", F.col("down").alias("_at")).join(sizes, "_k"), "_k", hung.count())
    above = above.where("down <= _at and up >= _at").select("_k", F.col("child").alias("_i"), "down")
    starts = one.unionByName(alone).select("_k", F.col("root").alias("_i"), F.lit(-1).cast("long").alias("down"))
    return ranked(above.unionByName(starts), "_k", ["down"], "ord").select("_k", "_i", "ord")


def along(points: DataFrame, dims: int, path: DataFrame, orient: bool) -> DataFrame:
    """_k, _i, ord, s and components of the vertices of paths, in the direction of the velocities if asked for: s is the
    length of the path up to the vertex."""
    q, v = [f"_q{i}" for i in range(dims)], [f"_v{i}" for i in range(dims)]
    r = Ranges(path.join(points, ["_k", "_i"]), "_k", ["ord"]).previous({f"_before{c}": c for c in (*q, *v)})
    step = F.coalesce(P.euclidean_distance([F.col(f"_before{c}") for c in q], [F.col(c) for c in q]), F.lit(0.0))
    rows = r.running({"s": step}).rows()
    if orient:
        turn = P.dot([F.col(c) - F.col(f"_before{c}") for c in q], [(F.col(c) + F.col(f"_before{c}")) / 2 for c in v])
        rows = stored(rows.withColumn("_turn", turn), "path-along")
        whole = rows.groupBy("_k").agg(F.count("*").alias("n"), F.max("s").alias("_all"), F.count("*").alias("_n"), (F.coalesce(F.sum("_turn"), F.lit(0.0)) < 0).alias("_flip"))
        rows = join_common(rows, whole, "_k", rows.count())
        rows = rows.withColumns({"ord": F.when(F.col("_flip"), F.col("_n") - 1 - F.col("ord")).otherwise(F.col("ord")), "s": F.when(F.col("_flip"), F.col("_all") - F.col("s")).otherwise(F.col("s"))})
    return stored(rows.select("_k", "_i", "ord", "s", *q), "path-along")


def settle(points: DataFrame, dims: int, links: DataFrame, *, on_disconnected: str, sigma: float | None, rounds: int, orient: bool, least_ratio: float, small_share: float) -> DataFrame:
    """_k, _i, ord, vertex of points by links (_k, a, b, w): the order along the backbone, and the place on it."""
    at = blocks(points, dims)
    tree = forest(links, at)
    nodes, pieces = largest(points, tree, at)
    if on_disconnected == "raise" and (some := pieces.where("n_pieces > 1").head()):
        raise ValueError(f"the links of a curve fall into {some['n_pieces']} components; raise k or jump_cap")
    own = stored(_within(tree, nodes), "curve-tree")
    if sigma is not None:
        nodes = stored(clipped(points, dims, own, nodes, sigma, rounds, least_ratio, small_share, at), "curve-clipped")
        own = stored(_within(own, nodes), "curve-tree")
    vertices = along(points, dims, longest_path(nodes, own, at), orient)
    q = [f"_q{i}" for i in range(dims)]
    near = nearest_vertex(points.join(nodes, ["_k", "_i"], "left_semi"), vertices.select("_k", F.col("ord").alias("_n"), *q), q)
    at = near.join(vertices.select("_k", F.col("ord").alias("_n"), "s"), ["_k", "_n"]).select("_k", "_i", "s")
    order = ranked(at, "_k", ["s", "_i"], "ord").select("_k", "_i", "ord")
    place = vertices.select("_k", "_i", F.col("ord").alias("vertex"))
    return points.select("_k", "_i").join(order, ["_k", "_i"], "left").join(place, ["_k", "_i"], "left")
