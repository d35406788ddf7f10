"""Queries over the tracers (embeddings as points of phase space) and their SQL."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright import nn, sql
from arcwright.functions import metrics as M
from arcwright.functions import mixture
from arcwright.functions import phasespace as P
from arcwright.operators import neighbors, results, statistics, walk
from arcwright.operators.mst import MSTOrderer
from arcwright.sources import TRACERS as S
from arcwright.sources import tracers
from arcwright.tables import stored

DIGITS = 6
#: Options of the walks, each stated once for the query and for its SQL.
SCALE, MAX_DIST, N_MAX, STOP_AT = 0.05, 0.25, 20, 100
GAMMAS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _rounded(*columns) -> list:
    return [F.round(c, DIGITS).alias(name) for name, c in columns]


# -- SQL pieces ---------------------------------------------------------------------------------------------------

_T = "t AS MATERIALIZED (SELECT label AS stream_id, vec_id AS idx, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate([*S.q, *S.v])) + " FROM embeddings)"


def _norm(a: list[str]) -> str:
    return "sqrt(" + " + ".join(f"({x}) * ({x})" for x in a) + ")"


def _between(a: str, b: str, names) -> list[str]:
    return [f"{b}.{c} - {a}.{c}" for c in names]


def _unit(a: list[str]) -> list[str]:
    n = _norm(a)
    return [f"(CASE WHEN {n} <> 0 THEN ({x}) / {n} ELSE 0 END)" for x in a]


def _metric(kind: str, a: str, b: str, scale: float, sign: int = 1) -> str:
    d = _norm(_between(a, b, S.q))
    if kind == "spatial":
        return d
    if kind == "full":
        w = f"({scale} * {_norm(_between(a, b, S.v))})"
        return f"sqrt({d} * {d} + {w} * {w})"
    cosine = " + ".join(f"{x} * {y}" for x, y in zip(_unit([f"{sign} * {a}.{c}" for c in S.v]), _unit(_between(a, b, S.q)), strict=True))
    return f"{d} + {scale} * (1 - ({cosine}))"


_START = "s AS (SELECT * FROM t WHERE (stream_id, idx) IN (SELECT stream_id, min(idx) FROM t GROUP BY stream_id))"


def _pairs_sql(*columns: tuple[str, str]) -> str:
    """Each point b with the start a of its stream."""
    return f"WITH {_T}, {_START} SELECT b.stream_id, b.idx, " + ", ".join(f"round({x}, {DIGITS}) AS {n}" for n, x in columns) + " FROM t b JOIN s a ON a.stream_id = b.stream_id"


def _walk_ctes(kind: str, name: str = "w", sign: int = 1, max_dist: float | None = None, n_max: int | None = None, stop: int | None = None, near: str = "") -> str:
    far = "" if max_dist is None else f"HAVING min({_norm(_between('a', 'b', S.q))}) <= {max_dist} AND arg_min({_norm(_between('a', 'b', S.q))}, row({_metric(kind, 'a', 'b', SCALE, sign)}, b.idx)) <= {max_dist}"
    more = ("" if n_max is None else f" AND ord + 1 < {n_max}") + ("" if stop is None else f" AND {name}.cur <> {stop}")
    return f"""{name}(stream_id, ord, cur, seen) AS (SELECT stream_id, 0, min(idx), [min(idx)] FROM t GROUP BY stream_id
UNION ALL SELECT {name}.stream_id, {name}.ord + 1, arg_min(b.idx, row({_metric(kind, 'a', 'b', SCALE, sign)}, b.idx)), list_append({name}.seen, arg_min(b.idx, row({_metric(kind, 'a', 'b', SCALE, sign)}, b.idx)))
FROM {name} JOIN t a ON a.stream_id = {name}.stream_id AND a.idx = {name}.cur JOIN t b ON b.stream_id = {name}.stream_id AND NOT list_contains({name}.seen, b.idx) {near}
WHERE TRUE{more} GROUP BY {name}.stream_id, {name}.ord, {name}.cur, {name}.seen {far})"""


def _walk_sql(kind: str, **options) -> str:
    return f"WITH RECURSIVE {_T}, {_walk_ctes(kind, **options)} SELECT stream_id, cur AS idx, CAST(ord AS BIGINT) AS ord FROM w"


# -- scalars and metrics ------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracers(spark, sf_dir)
    names = [*S.q, *S.v]
    start = t.groupBy("stream_id").agg(F.min_by(F.struct(*names), "idx").alias("a"))
    return t.join(start.withColumnRenamed("stream_id", "_s"), F.col("stream_id").eqNullSafe(F.col("_s"))).select("stream_id", "idx", *(F.col(f"a.{c}").alias(f"a_{c}") for c in names), *(F.col(c).alias(f"b_{c}") for c in names))


def _ends() -> tuple:
    """Positions, then velocities, of the start a and the point b."""
    return S.position("a_"), S.position("b_"), S.velocity("a_"), S.velocity("b_")


@_query(_pairs_sql(("distance", _norm(_between("a", "b", S.q)))))
def euclidean_distance(spark, sf_dir):
    return _pairs(spark, sf_dir).select("stream_id", "idx", *_rounded(("distance", P.euclidean_distance(*_ends()[:2]))))


@_query(_pairs_sql(*((f"u{c}", x) for c, x in zip(S.q, _unit(_between("a", "b", S.q)), strict=True))))
def unit_direction(spark, sf_dir):
    return _pairs(spark, sf_dir).select("stream_id", "idx", *_rounded(*((f"u{c}", x) for c, x in zip(S.q, P.unit_direction(*_ends()[:2]), strict=True))))


@_query(_pairs_sql(("speed", _norm([f"b.{c}" for c in S.v]))))
def velocity_norm(spark, sf_dir):
    return _pairs(spark, sf_dir).select("stream_id", "idx", *_rounded(("speed", P.velocity_norm(_ends()[3]))))


@_query(_pairs_sql(*((f"u{c}", x) for c, x in zip(S.v, _unit([f"b.{c}" for c in S.v]), strict=True))))
def unit_velocity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("stream_id", "idx", *_rounded(*((f"u{c}", x) for c, x in zip(S.v, P.unit_velocity(_ends()[3]), strict=True))))


@_query(_pairs_sql(("cosine", " + ".join(f"{x} * {y}" for x, y in zip(_unit([f"a.{c}" for c in S.v]), _unit([f"b.{c}" for c in S.v]), strict=True)))))
def cosine_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("stream_id", "idx", *_rounded(("cosine", P.cosine_similarity(*_ends()[2:]))))


_METRICS: dict[str, M.Metric] = {"spatial": M.Spatial(), "aligned": M.AlignedMomentum(), "full": M.FullPhaseSpace()}


def _metric_query(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b, va, vb = _ends()
        return _pairs(spark, sf_dir).select("stream_id", "idx", *_rounded(("distance", _METRICS[kind].column(a, va, b, vb, 0.5))))

    return run


for _k in _METRICS:
    QUERIES[f"metric_{_k}"] = _metric_query(_k)
    ORACLE_SQL[f"metric_{_k}"] = _pairs_sql(("distance", _metric(_k, "a", "b", 0.5)))


@_query(f"WITH {_T} SELECT * FROM t WHERE idx IN (1, 5, 100)")
def rows_at(spark, sf_dir):
    return results.at(tracers(spark, sf_dir), S, [1, 5, 100])


# -- neighbours ---------------------------------------------------------------------------------------------------

_KNN = f"n AS (SELECT a.stream_id, a.idx, b.idx AS neighbor, {_norm(_between('a', 'b', S.q))} AS distance, row_number() OVER (PARTITION BY a.stream_id, a.idx ORDER BY {_norm(_between('a', 'b', S.q))}, b.idx) AS rank FROM t a JOIN t b ON a.stream_id = b.stream_id AND a.idx <> b.idx QUALIFY rank <= 10)"


@_query(f"WITH {_T}, {_KNN} SELECT stream_id, idx, neighbor, round(distance, {DIGITS}) AS distance, rank FROM n")
def knn(spark, sf_dir):
    return neighbors.knn(tracers(spark, sf_dir), S, 10).withColumn("distance", F.round("distance", DIGITS)).withColumn("rank", F.col("rank").cast("long"))


_COSINE = f"CASE WHEN {_norm([f'p.{c}' for c in S.v])} * {_norm([f'q.{c}' for c in S.v])} > 1e-12 THEN ({' + '.join(f'p.{c} * q.{c}' for c in S.v)}) / ({_norm([f'p.{c}' for c in S.v])} * {_norm([f'q.{c}' for c in S.v])}) ELSE 0 END"
_EDGES = f"{_KNN}, e AS (SELECT l.stream_id, a, b, distance, {_COSINE} AS cosine FROM (SELECT DISTINCT stream_id, least(idx, neighbor) AS a, greatest(idx, neighbor) AS b, distance FROM n) l JOIN t p ON p.stream_id = l.stream_id AND p.idx = a JOIN t q ON q.stream_id = l.stream_id AND q.idx = b)"


@_query(f"WITH {_T}, {_EDGES} SELECT stream_id, a, b, round(distance, {DIGITS}) AS distance FROM e")
def knn_edges(spark, sf_dir):
    return neighbors.edges(tracers(spark, sf_dir), S, 10).select("stream_id", "a", "b", *_rounded(("distance", F.col("distance"))))


@_query(f"WITH {_T}, {_EDGES} SELECT stream_id, a, b, round(cosine, {DIGITS}) AS cosine, round(distance + 0.5 * (1 - cosine), {DIGITS}) AS weight FROM e")
def velocity_edge_weights(spark, sf_dir):
    return neighbors.edges(tracers(spark, sf_dir), S, 10, velocity_weight=0.5).select("stream_id", "a", "b", *_rounded(("cosine", F.col("cosine")), ("weight", F.col("weight"))))


@_query(f"WITH {_T}, {_EDGES} SELECT stream_id, a, b FROM e WHERE distance <= 0.2 AND cosine >= 0.25")
def severed_edges(spark, sf_dir):
    return neighbors.edges(tracers(spark, sf_dir), S, 10, jump_cap=0.2, sever_cos_threshold=0.25).select("stream_id", "a", "b")


@_query(f"WITH {_T}, {_EDGES}, l AS (SELECT stream_id, ln(distance) AS x FROM e), m AS (SELECT stream_id, median(x) AS mid FROM l GROUP BY stream_id) SELECT m.stream_id, round(mid, {DIGITS}) AS mid, round(1.4826 * median(abs(x - mid)), {DIGITS}) AS spread FROM l JOIN m ON l.stream_id = m.stream_id GROUP BY m.stream_id, mid")
def edge_clip_stat(spark, sf_dir):
    e = neighbors.edges(tracers(spark, sf_dir), S, 10).select("stream_id", F.log("distance").alias("x"))
    mid = e.groupBy(F.col("stream_id").alias("_s")).agg(F.median("x").alias("mid"))
    return e.join(mid, F.col("stream_id").eqNullSafe(F.col("_s"))).groupBy("stream_id", "mid").agg(F.median(F.abs(F.col("x") - F.col("mid"))).alias("d")).select("stream_id", *_rounded(("mid", F.col("mid")), ("spread", F.lit(1.4826) * F.col("d"))))


# -- walks --------------------------------------------------------------------------------------------------------


def _orderer(kind: str, **options) -> walk.LocalFlowOrderer:
    return walk.LocalFlowOrderer(SCALE, walk.WalkConfig(_METRICS[kind]), **options)


def _walked(kind: str, **options) -> Query:
    return lambda spark, sf_dir: results.visited(walk.order(tracers(spark, sf_dir), S, _orderer(kind, **options)))


for _k in _METRICS:
    QUERIES[f"walk_{_k}"], ORACLE_SQL[f"walk_{_k}"] = _walked(_k), _walk_sql(_k)
for _name, _options, _sql in (
    ("walk_max_dist", {"max_dist": MAX_DIST}, {"max_dist": MAX_DIST}),
    ("walk_n_max", {"n_max": N_MAX}, {"n_max": N_MAX}),
    ("walk_terminate", {"terminate": frozenset({STOP_AT})}, {"stop": STOP_AT}),
    ("walk_backward", {"direction": "backward"}, {"sign": -1}),
):
    QUERIES[_name], ORACLE_SQL[_name] = _walked("aligned", **_options), _walk_sql("aligned", **_sql)


@_query(f"""WITH RECURSIVE {_T}, {_walk_ctes('aligned', 'f', max_dist=MAX_DIST)}, {_walk_ctes('aligned', 'g', -1, max_dist=MAX_DIST)},
p AS (SELECT stream_id, cur AS idx, min(place) AS place FROM (SELECT stream_id, cur, ord AS place FROM f UNION ALL SELECT stream_id, cur, -ord FROM g WHERE ord > 0) GROUP BY stream_id, cur)
SELECT stream_id, idx, row_number() OVER (PARTITION BY stream_id ORDER BY place) - 1 AS ord FROM p""")
def walk_both(spark, sf_dir):
    return _walked("aligned", direction="both", max_dist=MAX_DIST)(spark, sf_dir)


@_query(ORACLE_SQL["walk_both"])
def combine_results(spark, sf_dir):
    t = tracers(spark, sf_dir)
    one, two = (walk.order(t, S, _orderer("aligned", direction=d, max_dist=MAX_DIST)) for d in ("forward", "backward"))
    return results.visited(walk.combine_results(one, two, S))


@_query(f"WITH RECURSIVE {_T}, {_KNN.replace('n AS (', 'n AS MATERIALIZED (', 1)}, {_walk_ctes('aligned', near='JOIN n ON n.stream_id = w.stream_id AND n.idx = w.cur AND n.neighbor = b.idx')} SELECT stream_id, cur AS idx, CAST(ord AS BIGINT) AS ord FROM w")
def walk_nearest(spark, sf_dir):
    return results.visited(walk.order(tracers(spark, sf_dir), S, walk.LocalFlowOrderer(SCALE, walk.WalkConfig(M.AlignedMomentum(), walk.Nearest(10)))))


# -- results ------------------------------------------------------------------------------------------------------

_FAR = f"{_T}, {_walk_ctes('aligned', max_dist=MAX_DIST)}"


def _far_walk(spark, sf_dir) -> DataFrame:
    return walk.order(tracers(spark, sf_dir), S, _orderer("aligned", max_dist=MAX_DIST))


@_query(f"WITH RECURSIVE {_FAR} SELECT stream_id, idx FROM t WHERE (stream_id, idx) NOT IN (SELECT stream_id, cur FROM w)")
def skipped_indices(spark, sf_dir):
    return results.skipped(_far_walk(spark, sf_dir))


@_query(f"WITH RECURSIVE {_FAR} SELECT t.stream_id, count(w.cur) AS n_visited, count(*) - count(w.cur) AS n_skipped, count(w.cur) = count(*) AS all_visited FROM t LEFT JOIN w ON w.stream_id = t.stream_id AND w.cur = t.idx GROUP BY t.stream_id")
def result_counts(spark, sf_dir):
    return results.counts(_far_walk(spark, sf_dir), S)


_O = f"o AS (SELECT t.*, w.ord, count(*) OVER (PARTITION BY t.stream_id) AS n FROM t JOIN w ON w.stream_id = t.stream_id AND w.cur = t.idx)"


@_query(f"WITH RECURSIVE {_FAR}, {_O}, g AS (SELECT DISTINCT stream_id, n, gamma, gamma * (n - 1) AS f FROM o, (VALUES {', '.join(f'({x})' for x in GAMMAS)}) v(gamma)) SELECT g.stream_id, CAST(gamma AS DOUBLE) AS gamma, " + ", ".join(f"round((1 - (f - floor(f))) * a.{c} + (f - floor(f)) * b.{c}, {DIGITS}) AS {c}" for c in S.q) + " FROM g JOIN o a ON a.stream_id = g.stream_id AND a.ord = floor(f) JOIN o b ON b.stream_id = g.stream_id AND b.ord = ceil(f)")
def interp_ordered(spark, sf_dir):
    r = _far_walk(spark, sf_dir)
    gammas = r.select("stream_id").distinct().withColumn("gamma", F.explode(F.array(*map(F.lit, GAMMAS))))
    return results.interpolate(tracers(spark, sf_dir), r, gammas, S).select("stream_id", "gamma", *_rounded(*((c, F.col(c)) for c in S.q)))


# -- statistics ---------------------------------------------------------------------------------------------------

_STATS = "m AS (SELECT stream_id, " + ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) + 1e-8 AS std_{c}" for c in [*S.q, *S.v]) + " FROM t GROUP BY stream_id)"


@_query(f"WITH {_T}, {_STATS} SELECT stream_id, " + ", ".join(f"round({k}_{c}, {DIGITS}) AS {k}_{c}" for c in [*S.q, *S.v] for k in ("mean", "std")) + " FROM m")
def standard_scaler_fit(spark, sf_dir):
    stats = statistics.StandardScaler.fit(tracers(spark, sf_dir), S).stats
    return stats.select("stream_id", *_rounded(*((n, F.col(n)) for n in stats.columns[1:])))


@_query(f"WITH {_T}, {_STATS} SELECT t.stream_id, idx, " + ", ".join(f"round(({c} - mean_{c}) / std_{c}, {DIGITS}) AS {c}" for c in [*S.q, *S.v]) + " FROM t JOIN m ON m.stream_id = t.stream_id")
def standard_scaler_transform(spark, sf_dir):
    t = tracers(spark, sf_dir)
    return statistics.StandardScaler.fit(t, S).transform(t).select("stream_id", "idx", *_rounded(*((c, F.col(c)) for c in [*S.q, *S.v])))


@_query(f"WITH {_T} SELECT stream_id, idx, " + ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in [*S.q, *S.v]) + " FROM t")
def scaler_roundtrip(spark, sf_dir):
    t = tracers(spark, sf_dir)
    scaler = statistics.StandardScaler.fit(t, S)
    return scaler.inverse_transform(scaler.transform(t)).select("stream_id", "idx", *_rounded(*((c, F.col(c)) for c in [*S.q, *S.v])))


_STEP = "d AS (SELECT stream_id, idx, ord, n, coalesce(" + _norm([f"{c} - lag({c}) OVER (PARTITION BY stream_id ORDER BY ord)" for c in S.q]) + ", 0) AS ds FROM o)"


@_query(f"WITH RECURSIVE {_FAR}, {_O}, {_STEP}, c AS (SELECT *, sum(ds) OVER (PARTITION BY stream_id ORDER BY ord) AS s, sum(ds) OVER (PARTITION BY stream_id) AS total FROM d) SELECT stream_id, idx, round(0.2 * CASE WHEN n > 1 THEN ord / (n - 1) ELSE 0 END + 0.8 * CASE WHEN total > 0 THEN s / total WHEN n > 1 THEN ord / (n - 1) ELSE 0 END, {DIGITS}) AS gamma FROM c")
def gamma_targets(spark, sf_dir):
    o = results.ordered(tracers(spark, sf_dir), _far_walk(spark, sf_dir), S)
    return statistics.gamma_targets(o, S).withColumn("gamma", F.round("gamma", DIGITS))


def _box(c: str) -> str:
    half = f"0.5 * CASE WHEN max({c}) = min({c}) THEN 1 ELSE max({c}) - min({c}) END"
    return f"round(min({c}) - {half}, {DIGITS}) AS low_{c}, round(max({c}) + {half}, {DIGITS}) AS high_{c}"


@_query(f"WITH {_T} SELECT stream_id, " + ", ".join(_box(c) for c in [*S.q, *S.v]) + " FROM t GROUP BY stream_id")
def bounding_box(spark, sf_dir):
    b = statistics.bounding_box(tracers(spark, sf_dir), S)
    return b.select("stream_id", *_rounded(*((c, F.col(c)) for c in b.columns[1:])))


_DENSITY = "1 / (" + " * ".join(f"CASE WHEN max({c}) > min({c}) THEN max({c}) - min({c}) ELSE 1 END" for c in S.q) + ")"


@_query(f"WITH {_T} SELECT stream_id, round({_DENSITY}, {DIGITS}) AS density FROM t GROUP BY stream_id")
def background_density(spark, sf_dir):
    return statistics.uniform_background_density(tracers(spark, sf_dir), S).withColumn("density", F.round("density", DIGITS))


def _gammas(spark, sf_dir) -> DataFrame:
    """x, as a coordinate along the curve."""
    return tracers(spark, sf_dir).withColumn("gamma", F.col("x"))


@_query(f"WITH {_T} SELECT a.stream_id, a.idx, round(1 / avg(exp(-0.5 * power((a.x - b.x) / 0.02, 2))), {DIGITS}) AS weight FROM t a JOIN t b ON a.stream_id = b.stream_id GROUP BY a.stream_id, a.idx")
def kde_weights(spark, sf_dir):
    return statistics.inverse_density_weights(_gammas(spark, sf_dir), S).withColumn("weight", F.round("weight", DIGITS))


@_query(f"WITH {_T} SELECT a.stream_id, a.idx, " + ", ".join(f"round(sum(b.{c}) / (count(*) + 1e-10), {DIGITS}) AS {c}" for c in S.q) + " FROM t a JOIN t b ON a.stream_id = b.stream_id AND abs(a.x - b.x) < 0.05 GROUP BY a.stream_id, a.idx")
def running_mean(spark, sf_dir):
    g = _gammas(spark, sf_dir)
    return statistics.running_mean(g, g, S, 0.1).select("stream_id", "idx", *_rounded(*((c, F.col(c)) for c in S.q)))


_R2, _PRIOR, _SIGMA = " + ".join(f"{c} * {c}" for c in S.q), "abs(vx) / (1 + abs(vx))", "0.1 + abs(vy)"
_FG = f"ln(p) - 0.5 * r2 / (s * s) - 3 * ln(s) - {0.5 * 3 * math.log(2 * math.pi)!r}"
_MIX = f"x AS (SELECT stream_id, idx, least(greatest({_PRIOR}, 1e-6), 1 - 1e-6) AS p, {_R2} AS r2, {_SIGMA} AS s FROM t), y AS (SELECT stream_id, idx, {_FG} AS fg, ln(1 - p) + ln(0.5) AS bg FROM x)"


def _mixture_columns():
    speed = F.abs(F.col("vx"))
    return speed / (F.lit(1.0) + speed), P.dot(S.position(), S.position()), F.lit(0.1) + F.abs(F.col("vy")), F.lit(math.log(0.5))


@_query(f"WITH {_T}, {_MIX} SELECT stream_id, idx, round(1 / (1 + exp(bg - fg)), {DIGITS}) AS responsibility FROM y")
def responsibility(spark, sf_dir):
    return tracers(spark, sf_dir).select("stream_id", "idx", *_rounded(("responsibility", mixture.membership_responsibility(*_mixture_columns(), 3))))


@_query(f"WITH {_T}, {_MIX} SELECT stream_id, round(-avg(greatest(fg, bg) + ln(1 + exp(-abs(fg - bg)))), {DIGITS}) AS loss FROM y GROUP BY stream_id")
def mixture_nll(spark, sf_dir):
    return mixture.mixture_loss(tracers(spark, sf_dir), ["stream_id"], mixture.log_likelihood(*_mixture_columns(), 3), F.lit(True)).withColumn("loss", F.round("loss", DIGITS))


#: A rampup below 1, and a mask that holds for some rows of even streams and for none of odd ones.
RAMPUP, _MASK = 0.4, "stream_id % 2 = 0 AND vy > 0"
_RAMPED = f"""x AS (SELECT stream_id, {_MASK} AS kept, least(greatest(1 - {RAMPUP} * (1 - {_PRIOR}), 1e-6), 1 - 1e-6) AS p, {_R2} AS r2, {_SIGMA} AS s FROM t),
y AS (SELECT stream_id, kept, {_FG} AS fg, ln(1 - p) + ln(0.5) AS bg FROM x)"""


@_query(f"WITH {_T}, {_RAMPED} SELECT stream_id, round(coalesce(-avg(greatest(fg, bg) + ln(1 + exp(-abs(fg - bg)))) FILTER (WHERE kept), 0), {DIGITS}) AS loss FROM y GROUP BY stream_id")
def mixture_nll_ramped(spark, sf_dir):
    rows = mixture.mixture_loss(tracers(spark, sf_dir), ["stream_id"], mixture.log_likelihood(*_mixture_columns(), 3, RAMPUP), F.expr(_MASK))
    return rows.withColumn("loss", F.round("loss", DIGITS))


#: Epochs of the schedules, which go round with idx.
EPOCHS = 20


@_query(f"WITH {_T} SELECT stream_id, idx, idx % {EPOCHS} AS epoch, round(0.5 * power(0.1 / 0.5, (idx % {EPOCHS}) / {EPOCHS - 1}), {DIGITS}) AS sigma FROM t")
def sigma_ceiling(spark, sf_dir):
    epoch = F.col("idx") % EPOCHS
    return tracers(spark, sf_dir).select("stream_id", "idx", epoch.alias("epoch"), *_rounded(("sigma", mixture.sigma_ceiling_column(epoch, EPOCHS))))


@_query(f"WITH {_T} SELECT stream_id, idx, idx % {EPOCHS} AS epoch, round(least(1.0, (idx % {EPOCHS}) / (0.3 * {EPOCHS - 1})), {DIGITS})::DOUBLE AS ramp FROM t")
def membership_rampup(spark, sf_dir):
    epoch = F.col("idx") % EPOCHS
    return tracers(spark, sf_dir).select("stream_id", "idx", epoch.alias("epoch"), *_rounded(("ramp", mixture.membership_rampup_column(epoch, EPOCHS))))


@_query(f"WITH {_T} SELECT stream_id, idx, round(x, {DIGITS}) AS gamma, " + ", ".join(f"round({f}(pi() * {k} * x), {DIGITS}) AS {f}_{k}" for k in range(1, 4) for f in ("sin", "cos")) + " FROM t")
def fourier_features(spark, sf_dir):
    t = tracers(spark, sf_dir).select("stream_id", "idx", *statistics.fourier_features(F.col("x"), 3))
    return t.select("stream_id", "idx", *_rounded(*((c, F.col(c)) for c in t.columns[2:])))


# -- spanning trees -----------------------------------------------------------------------------------------------

_TREE = MSTOrderer(k=10, jump_cap=10.0, on_disconnected="largest")


#: A tree grown by the least link to a point outside it, over links of nearest neighbours (here every curve is one piece).
_PRIM = f"""{_EDGES}, u AS MATERIALIZED (SELECT stream_id, a, b, distance FROM e UNION ALL SELECT stream_id, b, a, distance FROM e),
g(stream_id, seen, total, a, b, w) AS (SELECT stream_id, [min(idx)], CAST(0 AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM t GROUP BY stream_id
UNION ALL SELECT g.stream_id, list_append(g.seen, arg_min(u.b, row(u.distance, u.b))), g.total + min(u.distance), arg_min(u.a, row(u.distance, u.b)), arg_min(u.b, row(u.distance, u.b)), min(u.distance) FROM g JOIN u ON u.stream_id = g.stream_id AND list_contains(g.seen, u.a) AND NOT list_contains(g.seen, u.b) GROUP BY g.stream_id, g.seen, g.total)"""
_TREE_SQL = f"{_PRIM}, m AS MATERIALIZED (SELECT stream_id, a, b, w FROM g WHERE a IS NOT NULL)"


def _path_sql(nodes: str = "SELECT stream_id, idx FROM t", oriented: bool = False) -> str:
    """The backbone of the tree over the nodes: the farthest node from the first, the farthest from that, the way between;
    then all nodes in the order of their nearest vertices."""
    near = " AND ".join("z.stream_id = p.stream_id AND z.idx = p.node".split(" AND "))
    sweep = lambda name, first: f"{name}(stream_id, node, prev, d) AS ({first} UNION ALL SELECT y.stream_id, y.b, y.a, x.d + y.w FROM {name} x JOIN y ON y.stream_id = x.stream_id AND y.a = x.node AND y.b IS DISTINCT FROM x.prev)"
    turn = "sum(" + " + ".join(f"({c} - before_{c}) * (v{c} + before_v{c}) / 2" for c in S.q) + ")"
    lag = ", ".join(f"lag(z.{c}) OVER o AS before_{c}" for c in [*S.q, *S.v])
    return f"""k AS MATERIALIZED ({nodes}),
y AS MATERIALIZED (SELECT m.stream_id, m.a, m.b, m.w FROM (SELECT stream_id, a, b, w FROM m UNION ALL SELECT stream_id, b, a, w FROM m) m JOIN k i ON i.stream_id = m.stream_id AND i.idx = m.a JOIN k j ON j.stream_id = m.stream_id AND j.idx = m.b),
{sweep("d1", "SELECT stream_id, min(idx), CAST(NULL AS BIGINT), CAST(0 AS DOUBLE) FROM k GROUP BY stream_id")},
{sweep("d2", "SELECT stream_id, arg_max(node, row(d, -node)), CAST(NULL AS BIGINT), CAST(0 AS DOUBLE) FROM d1 GROUP BY stream_id")},
p0(stream_id, node, back) AS (SELECT stream_id, arg_max(node, row(d, -node)), 0 FROM d2 GROUP BY stream_id
UNION ALL SELECT p0.stream_id, d2.prev, p0.back + 1 FROM p0 JOIN d2 ON d2.stream_id = p0.stream_id AND d2.node = p0.node WHERE d2.prev IS NOT NULL),
p1 AS (SELECT stream_id, node, max(back) OVER (PARTITION BY stream_id) - back AS place, back FROM p0),
p2 AS (SELECT p.stream_id, p.place, z.*EXCLUDE (stream_id, idx), {lag} FROM p1 p JOIN t z ON {near} WINDOW o AS (PARTITION BY p.stream_id ORDER BY p.place)),
p3 AS (SELECT stream_id, {turn if oriented else "1.0"} AS way FROM p2 GROUP BY stream_id),
p AS MATERIALIZED (SELECT p1.stream_id, p1.node, CASE WHEN coalesce(way, 0) < 0 THEN back ELSE place END AS ord FROM p1 JOIN p3 ON p3.stream_id = p1.stream_id),
l AS (SELECT p.stream_id, p.ord, {", ".join(f"z.{c}" for c in S.q)}, coalesce({_norm([f"z.{c} - lag(z.{c}) OVER (PARTITION BY p.stream_id ORDER BY p.ord)" for c in S.q])}, 0) AS step FROM p JOIN t z ON {near}),
c AS MATERIALIZED (SELECT *, sum(step) OVER (PARTITION BY stream_id ORDER BY ord) AS along FROM l),
f AS (SELECT a.stream_id, a.idx, arg_min(b.along, row({_norm(_between("a", "b", S.q))}, b.ord)) AS along FROM t a JOIN k ON k.stream_id = a.stream_id AND k.idx = a.idx JOIN c b ON b.stream_id = a.stream_id GROUP BY a.stream_id, a.idx),
o AS (SELECT stream_id, idx, row_number() OVER (PARTITION BY stream_id ORDER BY along, idx) - 1 AS ord FROM f)"""


@_query(f"WITH RECURSIVE {_T}, {_TREE_SQL} SELECT stream_id, least(a, b) AS a, greatest(a, b) AS b, round(w, {DIGITS}) AS weight FROM m")
def mst_edges(spark, sf_dir):
    return _TREE.tree(tracers(spark, sf_dir), S).withColumn("weight", F.round("weight", DIGITS))


@_query(f"WITH RECURSIVE {_T}, {_PRIM} SELECT stream_id, max(len(seen)) - 1 AS n_edges, round(max(total), {DIGITS}) AS total FROM g GROUP BY stream_id")
def mst_total_weight(spark, sf_dir):
    return _TREE.tree(tracers(spark, sf_dir), S).groupBy("stream_id").agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), DIGITS).alias("total"))


@_query(f"WITH RECURSIVE {_T}, {_TREE_SQL}, {_path_sql()} SELECT stream_id, idx, ord FROM o")
def mst_order(spark, sf_dir):
    return results.visited(_TREE.order(tracers(spark, sf_dir), S))


#: Options of the clipping, stated once for the query and for its SQL.
CLIP_SIGMA, CLIP_ROUNDS = 2.0, 5


def _clip_sql() -> str:
    """Nodes k0, k1, ..: those left after each round of cutting long links and taking off small pieces."""
    out = ["k0 AS MATERIALIZED (SELECT stream_id, idx FROM t)", f"h AS MATERIALIZED (SELECT m.stream_id, m.a, m.b, ln({_norm(_between('i', 'j', S.q))}) AS x FROM m JOIN t i ON i.stream_id = m.stream_id AND i.idx = m.a JOIN t j ON j.stream_id = m.stream_id AND j.idx = m.b)"]
    for r in range(CLIP_ROUNDS):
        out += [
            f"h{r} AS MATERIALIZED (SELECT h.*, median(x) OVER (PARTITION BY h.stream_id) AS mid FROM h JOIN k{r} i ON i.stream_id = h.stream_id AND i.idx = h.a JOIN k{r} j ON j.stream_id = h.stream_id AND j.idx = h.b)",
            f"s{r} AS (SELECT stream_id, mid + greatest({CLIP_SIGMA} * 1.4826 * median(abs(x - mid)), ln(2.0)) AS most FROM h{r} GROUP BY stream_id, mid)",
            f"u{r} AS MATERIALIZED (SELECT h{r}.stream_id, a, b FROM h{r} JOIN s{r} ON s{r}.stream_id = h{r}.stream_id WHERE x <= most UNION ALL SELECT h{r}.stream_id, b, a FROM h{r} JOIN s{r} ON s{r}.stream_id = h{r}.stream_id WHERE x <= most)",
            f"r{r}(stream_id, idx, reached) AS (SELECT stream_id, idx, idx FROM k{r} UNION SELECT q.stream_id, q.idx, u.b FROM r{r} q JOIN u{r} u ON u.stream_id = q.stream_id AND u.a = q.reached)",
            f"z{r} AS (SELECT stream_id, idx, count(*) AS size FROM r{r} GROUP BY stream_id, idx)",
            f"k{r + 1} AS MATERIALIZED (SELECT stream_id, idx FROM (SELECT *, count(*) OVER (PARTITION BY stream_id) AS n FROM z{r}) WHERE size >= greatest(2, ceil(0.01 * n)))",
        ]
    return ", ".join(out)


@_query(f"WITH RECURSIVE {_T}, {_TREE_SQL}, {_clip_sql()}, {_path_sql(f'SELECT stream_id, idx FROM k{CLIP_ROUNDS}', oriented=True)} SELECT t.stream_id, t.idx, o.ord FROM t LEFT JOIN o ON o.stream_id = t.stream_id AND o.idx = t.idx")
def mst_edge_clip(spark, sf_dir):
    return MSTOrderer(k=10, jump_cap=10.0, on_disconnected="largest", edge_clip_sigma=CLIP_SIGMA, edge_clip_max_iters=CLIP_ROUNDS, orient_by_velocity=True).order(tracers(spark, sf_dir), S)


@_query(f"""WITH RECURSIVE {_T}, {_EDGES}, l AS MATERIALIZED (SELECT stream_id, a, b FROM e WHERE distance <= 0.12 UNION ALL SELECT stream_id, b, a FROM e WHERE distance <= 0.12),
r AS (SELECT stream_id, idx, idx AS reached FROM t UNION SELECT r.stream_id, r.idx, l.b FROM r JOIN l ON l.stream_id = r.stream_id AND l.a = r.reached)
SELECT stream_id, idx, min(reached) AS component FROM r GROUP BY stream_id, idx""")
def mst_components(spark, sf_dir):
    return MSTOrderer(k=10, jump_cap=0.12).components(tracers(spark, sf_dir), S)


@_query(f"WITH RECURSIVE {_T}, {_TREE_SQL}, {_path_sql()} SELECT stream_id, node AS idx, CAST(ord AS BIGINT) AS ord FROM p")
def backbone_project(spark, sf_dir):
    return _TREE.backbone(tracers(spark, sf_dir), S)


@_query(f"""WITH RECURSIVE {_T}, {_TREE_SQL}, {_path_sql()},
v AS (SELECT *, (gamma + 1) / 2 * (max(ord) OVER (PARTITION BY stream_id)) AS f FROM c, (VALUES {", ".join(f"({2 * x - 1})" for x in GAMMAS)}) v(gamma))
SELECT a.stream_id, CAST(a.gamma AS DOUBLE) AS gamma, """ + ", ".join(f"round((1 - (a.f - floor(a.f))) * a.{c} + (a.f - floor(a.f)) * b.{c}, {DIGITS}) AS {c}" for c in S.q) + " FROM v a JOIN c b ON b.stream_id = a.stream_id AND b.ord = ceil(a.f) WHERE a.ord = floor(a.f)")
def interp_backbone(spark, sf_dir):
    r = _TREE.result(tracers(spark, sf_dir), S)
    gammas = r.order.select("stream_id").distinct().withColumn("gamma", F.explode(F.array(*(F.lit(2 * x - 1) for x in GAMMAS))))
    return r(gammas).select("stream_id", "gamma", *_rounded(*((c, F.col(c)) for c in S.q)))


#: The same queries with curves that count as larger than a task: by joins and aggregates alone.
_SPREAD = {"mst_edges": "tree", "mst_components": "components", "mst_order": "order", "mst_edge_clip": "order", "backbone_project": "backbone"}


def _spread(name: str, method: str) -> Query:
    made = {
        "mst_components": MSTOrderer(k=10, jump_cap=0.12, at_once=0),
        "mst_edge_clip": MSTOrderer(k=10, jump_cap=10.0, on_disconnected="largest", edge_clip_sigma=CLIP_SIGMA, edge_clip_max_iters=CLIP_ROUNDS, orient_by_velocity=True, at_once=0),
    }.get(name, MSTOrderer(k=10, jump_cap=10.0, on_disconnected="largest", at_once=0))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = getattr(made, method)(tracers(spark, sf_dir), S)
        found = results.visited(found) if name == "mst_order" else found
        return found.withColumn("weight", F.round("weight", DIGITS)) if "weight" in found.columns else found

    return run


for _name, _method in _SPREAD.items():
    QUERIES[f"{_name}_spread"], ORACLE_SQL[f"{_name}_spread"] = _spread(_name, _method), ORACLE_SQL[_name]


# -- SQL functions and table functions ----------------------------------------------------------------------------


def _sql_view(spark: SparkSession, sf_dir: str) -> str:
    sql.register(spark, S)
    name = "curve_points_" + hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
    tracers(spark, sf_dir).createOrReplaceTempView(name)
    return name


@_query(_walk_sql("aligned"))
def sql_walk(spark, sf_dir):
    return spark.sql(f"SELECT stream_id, idx, ord FROM walk_order(TABLE({_sql_view(spark, sf_dir)}) PARTITION BY (stream_id), 'aligned', {SCALE}D) WHERE ord IS NOT NULL")


@_query(_pairs_sql(*((k, _metric(k, "a", "b", SCALE)) for k in _METRICS), ("cosine", " + ".join(f"{x} * {y}" for x, y in zip(_unit([f"a.{c}" for c in S.v]), _unit([f"b.{c}" for c in S.v]), strict=True)))))
def sql_metrics(spark, sf_dir):
    v = _sql_view(spark, sf_dir)
    q, w = (lambda t, names: "array(" + ", ".join(f"{t}.{c}" for c in names) + ")"), f"{SCALE}D"
    arguments = f"{q('a', S.q)}, {q('a', S.v)}, {q('b', S.q)}, {q('b', S.v)}, {w}"
    metrics = ", ".join(f"round(metric_{k}({arguments}), {DIGITS}) AS {k}" for k in _METRICS)
    return spark.sql(f"""WITH a AS (SELECT stream_id, p.* FROM (SELECT stream_id, min_by(struct({", ".join([*S.q, *S.v])}), idx) AS p FROM {v} GROUP BY stream_id))
SELECT b.stream_id, b.idx, {metrics}, round(phase_cosine({q("a", S.v)}, {q("b", S.v)}), {DIGITS}) AS cosine FROM {v} b JOIN a ON a.stream_id <=> b.stream_id""")


# -- models -------------------------------------------------------------------------------------------------------

#: The default training and networks, with the mixture that posterior_membership needs.
_CONFIG = nn.TrainingConfig(membership=mixture.MixtureMembershipConfig())


def _models(spark, sf_dir) -> DataFrame:
    """The table of models, trained once for a session and a folder of tables: five queries read it."""
    made = spark.__dict__.setdefault("_curve_models", {})
    if sf_dir not in made:
        t = tracers(spark, sf_dir)
        made[sf_dir] = stored(nn.train(t, walk.order(t, S, _orderer("aligned")), S, nn.PathAutoencoder(), _CONFIG), "models")
    return made[sf_dir]


@_query()
def train_losses(spark, sf_dir):
    return _models(spark, sf_dir).select("stream_id", F.posexplode("losses").alias("epoch", "loss"))


@_query()
def encode(spark, sf_dir):
    return nn.encode(tracers(spark, sf_dir), _models(spark, sf_dir), S)


@_query()
def decode(spark, sf_dir):
    m = _models(spark, sf_dir)
    return nn.decode(m.select("stream_id", F.explode(F.array(*(F.lit(x / 4) for x in range(-4, 5)))).alias("gamma")), m, S, (-1.0, 1.0))


@_query()
def fill_gaps(spark, sf_dir):
    return nn.fill_gaps(nn.encode(tracers(spark, sf_dir), _models(spark, sf_dir), S), S)


@_query()
def posterior_membership(spark, sf_dir):
    return nn.posterior(tracers(spark, sf_dir), _models(spark, sf_dir), S)


# -- networks of stated weights: what is applied to rows, against SQL ---------------------------------------------

STATED_SEED, MEAN, STD, BACKGROUND, WINDOW = 11, 0.05, 0.2, 0.01, 0.4
_HALF = len(S.q)


def _stated(track: str = "path") -> dict:
    """A small model with weights of a fixed seed, the same for every stream."""
    rng = np.random.default_rng(STATED_SEED)
    encoder, width = nn.OrderingNet(2 * _HALF, rng, 4, 1), nn.WidthNet(rng, 3, 1)
    width.mlp.w[-1][:] = rng.uniform(-1, 1, width.mlp.w[-1].shape)
    made = nn.FourierTrackNet(_HALF, rng, 2, 4, 2) if track == "fourier" else nn.TrackNet(_HALF, rng, 5, 2)
    return {"encoder": encoder, "track": made, "width": width, "mean": np.full(2 * _HALF, MEAN), "std": np.full(2 * _HALF, STD), "background": BACKGROUND}


def _stated_models(spark, sf_dir, track: str = "path") -> DataFrame:
    return tracers(spark, sf_dir).select("stream_id").distinct().withColumn("model", F.lit(bytearray(pickle.dumps(_stated(track)))))


def _mlp_sql(name: str, source: str, inputs: list[str], mlp: nn.Perceptron) -> tuple[str, str, list[str]]:
    """CTEs of the layers over the rows of source, the last one's name, and the columns of its outputs."""
    ctes = []
    for i, (w, b) in enumerate(zip(mlp.w, mlp.b, strict=True)):
        z = [" + ".join([repr(float(b[j])), *(f"{x} * ({float(w[k, j])!r})" for k, x in enumerate(inputs))]) for j in range(w.shape[1])]
        z = [f"tanh({x})" if mlp.bounded or i < len(mlp.w) - 1 else x for x in z]
        out = [f"{name}_{i}_{j}" for j in range(len(z))]
        ctes.append(f"{name}{i} AS MATERIALIZED (SELECT *, " + ", ".join(f"{x} AS {o}" for x, o in zip(z, out, strict=True)) + f" FROM {source})")
        source, inputs = f"{name}{i}", out
    return ", ".join(ctes), source, inputs


def _encoded_sql() -> str:
    """Rows e: stream_id, idx, scaled components, gamma, prob."""
    net = _stated()["encoder"]
    scaled = f"n0 AS (SELECT stream_id, idx, " + ", ".join(f"({c} - {MEAN}) / {STD} AS {c}" for c in [*S.q, *S.v]) + " FROM t)"
    body, source, out = _mlp_sql("b", "n0", [*S.q, *S.v], net.body)
    heads, source, (g, p) = _mlp_sql("h", source, out, net.heads)
    low, high = net.gamma_range
    return f"{scaled}, {body}, {heads}, e AS MATERIALIZED (SELECT stream_id, idx, {', '.join([*S.q, *S.v])}, {low} + ({high - low}) * (tanh({g}) + 1) / 2 AS gamma, 0.5 * (1 + tanh(0.5 * {p})) AS prob FROM {source})"


def _track_sql(source: str, kind: str = "path") -> tuple[str, str, list[str]]:
    net = _stated(kind)["track"]
    inputs = ["gamma"] if kind == "path" else ["gamma", *(f"{f}({float(k)!r} * gamma)" for f in ("sin", "cos") for k in net.k)]
    return _mlp_sql("q", source, inputs, net.mlp)


@_query(f"WITH {_T}, {_encoded_sql()} SELECT stream_id, idx, round(gamma, {DIGITS}) AS gamma, round(prob, {DIGITS}) AS prob FROM e")
def encode_stated(spark, sf_dir):
    return nn.encode(tracers(spark, sf_dir), _stated_models(spark, sf_dir), S).select("stream_id", "idx", *_rounded(("gamma", F.col("gamma")), ("prob", F.col("prob"))))


def _decoded_sql(kind: str) -> str:
    ctes, source, out = _track_sql("a", kind)
    return f"WITH {_T}, a AS (SELECT DISTINCT stream_id, (k - 4) / 4.0 AS gamma FROM t, range(9) r(k)), {ctes} SELECT stream_id, CAST(gamma AS DOUBLE) AS gamma, " + ", ".join(f"round({x} * {STD} + {MEAN}, {DIGITS}) AS {c}" for x, c in zip(out, S.q, strict=True)) + f" FROM {source}"


def _decoded(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = _stated_models(spark, sf_dir, kind)
        gammas = m.select("stream_id", F.explode(F.array(*(F.lit(x / 4) for x in range(-4, 5)))).alias("gamma"))
        return nn.decode(gammas, m, S, (-1.0, 1.0)).select("stream_id", "gamma", *_rounded(*((c, F.col(c)) for c in S.q)))

    return run


for _k in ("path", "fourier"):
    QUERIES[f"decode_{_k}_stated"], ORACLE_SQL[f"decode_{_k}_stated"] = _decoded(_k), _decoded_sql(_k)


def _posterior_sql() -> str:
    path, source, q = _track_sql("e")
    width, source, (raw,) = _mlp_sql("s", source, ["gamma"], _stated()["width"].mlp)
    r2 = " + ".join(f"({c} - {x}) * ({c} - {x})" for c, x in zip(S.q, q, strict=True))
    rows = f"y0 AS (SELECT stream_id, idx, gamma, prob, least(greatest(prob, 1e-6), 1 - 1e-6) AS p, {r2} AS r2, 0.001 + exp({raw}) AS s FROM {source})"
    return f"WITH {_T}, {_encoded_sql()}, {path}, {width}, {rows}, y1 AS (SELECT *, {_FG} AS fg, ln(1 - p) + ln({BACKGROUND}) AS bg FROM y0) SELECT stream_id, idx, round(gamma, {DIGITS}) AS gamma, round(prob, {DIGITS}) AS prob, round(1 / (1 + exp(bg - fg)), {DIGITS}) AS posterior FROM y1"


@_query(_posterior_sql())
def posterior_stated(spark, sf_dir):
    return nn.posterior(tracers(spark, sf_dir), _stated_models(spark, sf_dir), S).select("stream_id", "idx", *_rounded(*((c, F.col(c)) for c in ("gamma", "prob", "posterior"))))


@_query(f"WITH {_T}, {_encoded_sql()} SELECT stream_id, idx, row_number() OVER (PARTITION BY stream_id ORDER BY gamma, idx) - 1 AS ord FROM e WHERE prob >= 0.5")
def fill_gaps_stated(spark, sf_dir):
    return nn.fill_gaps(nn.encode(tracers(spark, sf_dir), _stated_models(spark, sf_dir), S), S)


@_query(f"WITH {_T}, {_encoded_sql()} SELECT a.stream_id, a.idx, " + ", ".join(f"round(coalesce(sum(b.{c}) / (count(b.idx) + 1e-10), 0) * {STD} + {MEAN}, {DIGITS}) AS {c}" for c in S.q) + f" FROM e a LEFT JOIN e b ON a.stream_id = b.stream_id AND b.prob >= 0.5 AND abs(b.gamma - a.gamma) < {WINDOW / 2} GROUP BY a.stream_id, a.idx")
def external_decode(spark, sf_dir):
    """Each row's gamma by the stated encoder, decoded by the running mean of the members around it."""
    t = tracers(spark, sf_dir)
    m = nn.external_models(t, _stated_models(spark, sf_dir), S, nn.RunningMeanDecoder(WINDOW))
    encoded = nn.encode(t, m, S)
    return nn.decode(encoded, m, S, keep=["idx"]).select("stream_id", "idx", *_rounded(*((c, F.col(c)) for c in S.q)))
