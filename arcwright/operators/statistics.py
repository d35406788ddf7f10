"""Scaling, targets, boxes, densities and running means of curves."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.functions import phasespace as P
from arcwright.functions import units as U
from arcwright.spec import Spec
from arcwright.tables import stored

from .keyed import join_common, key_of, stream_of
from .ranges import Ranges


class Normalizer(ABC):
    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    @abstractmethod
    def inverse_transform(self, df: DataFrame) -> DataFrame: ...

    @property
    @abstractmethod
    def n_spatial_dims(self) -> int: ...


class StandardScaler(Normalizer):
    """Per curve and component: less the mean, over the population deviation + 1e-8.

    Fitted on columns with units, it takes columns in any unit of the same kind (TypeError without one), gives plain numbers,
    and puts the units of the fit on what it transforms back.
    """

    def __init__(self, spec: Spec, stats: DataFrame, units: dict[str, str] | None = None) -> None:
        self.spec, self.stats, self.units = spec, stats, units or {}

    @classmethod
    def fit(cls, df: DataFrame, spec: Spec) -> StandardScaler:
        parts = [x for c in (*spec.q, *spec.v) for x in (F.avg(c).alias(f"mean_{c}"), (F.stddev_pop(c) + F.lit(1e-8)).alias(f"std_{c}"))]
        units = {c: u for c in (*spec.q, *spec.v) if (u := U.unit_of(df, c))}
        return cls(spec, df.groupBy(spec.stream).agg(*parts), units)

    @property
    def n_spatial_dims(self) -> int:
        return len(self.spec.q)

    def _joined(self, df: DataFrame, of) -> DataFrame:
        s = self.stats.select(F.col(self.spec.stream).alias("_s"), *(F.col(f"{k}_{c}").alias(f"_{k}_{c}") for c in (*self.spec.q, *self.spec.v) for k in ("mean", "std")))
        j = df.join(s, F.col(self.spec.stream).eqNullSafe(F.col("_s")))
        new = {c: of(F.col(c), F.col(f"_mean_{c}"), F.col(f"_std_{c}")) for c in (*self.spec.q, *self.spec.v) if c in df.columns}
        return j.withColumns(new).select(df.columns)

    def transform(self, df: DataFrame) -> DataFrame:
        for c in (*self.spec.q, *self.spec.v):
            if c in df.columns:
                own, fitted = U.unit_of(df, c), self.units.get(c, "")
                if bool(own) != bool(fitted):
                    raise TypeError(f"column {c} is in {own or 'no unit'}, and was fitted in {fitted or 'none'}")
                if own:
                    df = df.withColumn(c, U.converted(F.col(c), own, fitted)).withMetadata(c, {})
        return self._joined(df, lambda x, m, s: (x - m) / s)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        if marked := [c for c in (*self.spec.q, *self.spec.v) if c in df.columns and U.unit_of(df, c)]:
            raise TypeError(f"scaled columns are plain numbers, but {marked[0]} has a unit")
        return U.with_unit(self._joined(df, lambda x, m, s: x * s + m), **{c: u for c, u in self.units.items() if c in df.columns})


def gamma_targets(ordered: DataFrame, spec: Spec, gamma_range: tuple[float, float] = (0.0, 1.0), alpha: float = 0.8) -> DataFrame:
    """stream, idx, gamma: the rank along the order, blended by alpha with the arc length; by rank alone where that is 0.

    Arc lengths are running sums over ranges of the order, so a curve may be of any length."""
    low, high = gamma_range
    alpha = min(1.0, max(0.0, alpha))
    kind = ordered.schema[spec.stream].dataType
    names = [f"_q{i}" for i in range(len(spec.q))]
    rows = ordered.select(key_of(F.col(spec.stream)).alias("_k"), F.col(spec.idx).alias("_i"), F.col("ord").alias("_o"), *(F.col(c).cast("double").alias(n) for c, n in zip(spec.q, names, strict=True)))
    line = Ranges(rows, "_k", ["_o"]).previous({f"_b{n}": n for n in names})
    step = P.euclidean_distance([F.col(f"_b{n}") for n in names], [F.col(n) for n in names])
    rows = stored(line.running({"_arc": F.coalesce(step, F.lit(0.0))}).rows().select("_k", "_i", "_o", "_arc"), "gamma-arcs")
    whole = stored(rows.groupBy("_k").agg(F.count("*").alias("n"), F.count("*").alias("_n"), F.max("_arc").alias("_all")), "gamma-curves")
    rows = join_common(rows, whole, "_k", rows.count())
    rank = F.lit(low) + F.lit(high - low) * F.when(F.col("_n") > 1, F.col("_o") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    arc = F.when(F.col("_all") > 0, F.lit(low) + F.lit(high - low) * (F.col("_arc") / F.col("_all"))).otherwise(rank)
    return rows.select(stream_of(F.col("_k"), kind).alias(spec.stream), F.col("_i").alias(spec.idx), (F.lit(1 - alpha) * rank + F.lit(alpha) * arc).alias("gamma"))


def bounding_box(df: DataFrame, spec: Spec) -> DataFrame:
    """stream, low_c and high_c of each component: half the extent beyond the rows on each side; an extent of 0 counts as 1."""
    out = []
    for c in (*spec.q, *spec.v):
        e = F.max(c) - F.min(c)
        half = F.lit(0.5) * F.when(e == 0, F.lit(1.0)).otherwise(e)
        out += [(F.min(c) - half).alias(f"low_{c}"), (F.max(c) + half).alias(f"high_{c}")]
    return df.groupBy(spec.stream).agg(*out)


def uniform_background_density(df: DataFrame, spec: Spec, inflate: float = 1.0) -> DataFrame:
    """stream, density: one over the volume of the box of the positions, its extents times inflate; an extent of 0 counts as 1."""
    if not inflate > 0:
        raise ValueError("inflate must be positive")
    extents: list[Column] = []
    for c in spec.q:
        e = (F.max(c) - F.min(c)) * F.lit(float(inflate))
        extents.append(F.when(e > 0, e).otherwise(F.lit(1.0)))
    return df.groupBy(spec.stream).agg((F.lit(1.0) / reduce(mul, extents)).alias("density"))


def fourier_features(gamma: Column, n: int = 8) -> list[Column]:
    """gamma, then sin(pi k gamma) and cos(pi k gamma) for k from 1 to n."""
    angle = lambda k: F.lit(np.pi * k) * gamma
    return [gamma.alias("gamma"), *(f(angle(k)).alias(f"{name}_{k}") for k in range(1, n + 1) for name, f in (("sin", F.sin), ("cos", F.cos)))]


#: Powers of a series, and bins on each side of a row's own that can matter: of half a bandwidth each, so that what is left
#: out of a kernel is under 1e-13 by the series and under 1e-17 by the distance.
TERMS, REACH = 14, 18
#: Bins whose moments one task moves: what they add to the bins around them is summed before it is dealt.
CHUNK = 256


def _translations() -> np.ndarray:
    """[offset, k, m]: what the k-th moment of a bin adds to the m-th derivative of the kernel sum, offset bins further on.

    With t the distance of the centres in bandwidths and He Hermite polynomials, a point at d from its centre has at t the
    kernel sum_k d^k / k! He_k(t) exp(-t^2 / 2), whose m-th derivative has (-1)^m He_(k + m)(t) in place of He_k(t).
    """
    t = 0.5 * np.arange(-REACH, REACH + 1)
    he = [np.ones_like(t), t]
    for n in range(1, 2 * TERMS):
        he.append(t * he[n] - n * he[n - 1])
    k, m = np.indices((TERMS, TERMS))
    return np.moveaxis(np.array(he)[k + m] * ((-1.0) ** m)[..., None] * np.exp(-0.5 * t * t), -1, 0)


def inverse_density_weights(df: DataFrame, spec: Spec, bandwidth: float = 0.02) -> DataFrame:
    """stream, idx, weight: one over the mean Gaussian kernel between the row's gamma and those of its stream.

    A fast Gauss transform: bins of half a bandwidth are summed up to moments, moments are moved to the bins around them,
    and a row evaluates the series of its bin; work and shuffle grow with rows, not with pairs, and no task holds a curve.
    Rows whose gamma is null or not finite are left out and count for nothing.
    """
    if not bandwidth > 0:
        raise ValueError("bandwidth must be positive")
    kind = df.schema[spec.stream].dataType.simpleString()
    scaled = F.col("gamma").cast("double") / F.lit(float(bandwidth))
    finite = F.col("gamma").isNotNull() & ~F.isnan("gamma") & (F.abs("gamma") < F.lit(float("inf")))
    rows = df.where(finite).select(F.col(spec.stream).alias("_s"), F.col(spec.idx).alias("_i"), scaled.alias("_x"))
    rows = rows.withColumn("_bin", F.floor(F.col("_x") * 2)).withColumn("_d", F.col("_x") - (F.col("_bin") + 0.5) / 2)
    power, moments = F.lit(1.0), []
    for k in range(TERMS):
        moments.append(F.sum(power).alias(f"_m{k}"))
        power = power * F.col("_d") / (k + 1)
    bins = rows.groupBy("_s", "_bin").agg(*moments)
    names = [f"_m{k}" for k in range(TERMS)]

    def moved(own: pd.DataFrame) -> pd.DataFrame:
        """What the bins of a chunk add to those of the chunk and around it."""
        first = int(own["_bin"].min())
        at = own["_bin"].to_numpy() - first
        out = np.zeros((int(at.max()) + 1 + 2 * REACH, TERMS))
        table, moments = _translations(), own[names].to_numpy(float)
        for offset in range(-REACH, REACH + 1):
            out[at + REACH + offset] += moments @ table[offset + REACH]  # bins are distinct
        some = np.flatnonzero(out.any(axis=1))
        return pd.DataFrame({"_s": own["_s"].iloc[np.zeros(len(some), int)].reset_index(drop=True), "_bin": some + first - REACH, **dict(zip(names, out[some].T, strict=True))})

    chunks = bins.withColumn("_chunk", F.floor(F.col("_bin") / CHUNK))
    spread = chunks.groupBy("_s", "_chunk").applyInPandas(moved, f"_s {kind}, _bin long, " + ", ".join(f"{n} double" for n in names))
    series = spread.groupBy("_s", "_bin").agg(*(F.sum(n).alias(n) for n in names)).withColumnsRenamed({"_s": "_t", "_bin": "_to"})
    totals = bins.groupBy("_s").agg(F.sum("_m0").alias("_n")).withColumnRenamed("_s", "_u")
    total = F.lit(0.0)
    for m in reversed(range(TERMS)):
        total = F.col(f"_m{m}") + total * F.col("_d") / (m + 1)
    there = rows.join(series, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_bin") == F.col("_to"))).join(totals, F.col("_s").eqNullSafe(F.col("_u")))
    return there.select(F.col("_s").alias(spec.stream), F.col("_i").cast("long").alias(spec.idx), (F.col("_n") / total).alias("weight"))


def window_means(at: np.ndarray, gamma: np.ndarray, values: np.ndarray, width: float, counts: np.ndarray | None = None) -> np.ndarray:
    """Means of the values whose gamma is nearer than width / 2 to each ``at``; 0 where there are none.  With counts, values
    are sums of so many."""
    if not len(gamma):
        return np.zeros((len(at), values.shape[1] if values.ndim > 1 else 0))
    order = np.argsort(gamma, kind="stable")
    g, total = gamma[order], np.vstack([np.zeros(values.shape[1]), np.cumsum(values[order], axis=0)])
    n = np.concatenate([[0.0], np.cumsum(np.ones(len(g)) if counts is None else counts[order])])
    half = width / 2
    # strict by the difference itself, as rounding of at -+ half could take in or leave out a point at the edge
    low, high = np.searchsorted(g, at - half, "left"), np.searchsorted(g, at + half, "right")
    for side, step in ((low, 1), (high, -1)):
        while True:
            i = side if step > 0 else side - 1
            inside = (low < high) & (np.abs(g[np.clip(i, 0, len(g) - 1)] - at) >= half)
            if not inside.any():
                break
            side[inside] += step
    return (total[high] - total[low]) / ((n[high] - n[low])[:, None] + 1e-10)


def running_mean(members: DataFrame, at: DataFrame, spec: Spec, window_size: float = 0.05) -> DataFrame:
    """at (stream, idx, gamma) with the mean positions of the members (stream, gamma, positions) around gamma.

    Members of one gamma are summed first; gammas are cut into bins of a window's width, and a task takes a bin with the
    members of it and of the halves beside it, not a curve.  A gamma beyond those of the members is an error; rows and
    members whose gamma is null are left out.
    """
    if not window_size > 0:
        raise ValueError("window_size must be positive")
    kind = at.schema[spec.stream].dataType.simpleString()
    schema = f"`{spec.stream}` {kind}, `{spec.idx}` long, gamma double, " + ", ".join(f"`{c}` double" for c in spec.q)
    width, half = F.lit(float(window_size)), F.lit(float(window_size) / 2)

    # names of their own, as both tables may come from one
    names = [f"_q{i}" for i in range(len(spec.q))]
    known = members.where("gamma is not null").groupBy(F.col(spec.stream).alias("_s"), F.col("gamma").cast("double").alias("_g"))
    known = known.agg(F.count("*").alias("_n"), *(F.sum(F.col(c)).alias(n) for c, n in zip(spec.q, names, strict=True)))
    ends = known.groupBy(F.col("_s").alias("_e")).agg(F.min("_g").alias("_low"), F.max("_g").alias("_high"))
    # a bin more on each side than halves need, should a rounded quotient fall beyond an edge
    reached = F.sequence(F.floor((F.col("_g") - half * 1.01) / width), F.floor((F.col("_g") + half * 1.01) / width))
    near = known.withColumn("_bin", F.explode(reached))

    asked = at.where("gamma is not null").select(F.col(spec.stream).alias("_a"), F.col(spec.idx).cast("long").alias("_i"), F.col("gamma").cast("double").alias("_x"))
    asked = asked.join(ends, F.col("_a").eqNullSafe(F.col("_e")), "left")
    inside = (F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high"))
    checked = F.when(inside, F.col("_x")).otherwise(F.raise_error(F.lit("gamma is outside the range of the members")).cast("double"))
    asked = asked.select("_a", "_i", checked.alias("_x")).withColumn("_bin", F.floor(F.col("_x") / width))

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        x = rows["_x"].to_numpy(float)
        mean = window_means(x, own["_g"].to_numpy(float), own[names].to_numpy(float), window_size, own["_n"].to_numpy(float)) if len(x) else np.zeros((0, len(spec.q)))
        return pd.DataFrame({spec.stream: rows["_a"], spec.idx: rows["_i"], "gamma": x, **{c: mean[:, i] for i, c in enumerate(spec.q)}})

    return asked.groupBy("_a", "_bin").cogroup(near.groupBy("_s", "_bin")).applyInPandas(run, schema)
