"""Models of curves as rows (stream, model): trained one curve to a task, or handed from task to task, and applied
to any table in salted groups.

A model is a pickle of numpy weights made by ``train`` in the same cluster; tables of models from elsewhere aren't to be read.
Defined cases: a curve without visited points is an error; rows of a stream without a model give no rows.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.functions.mixture import MixtureMembershipConfig, membership_responsibility
from arcwright.operators.keyed import by_size, key_of, stream_of
from arcwright.operators.ranges import ranked
from arcwright.operators.results import Curve
from arcwright.operators.statistics import window_means
from arcwright.operators.walk import checked
from arcwright.spec import Spec
from arcwright.tables import discard, scratch, stored

from .networks import FourierTrackNet, OrderingNet, TrackNet, WidthNet
from .training import Course, TrainingConfig, background_density

#: Rows that one task encodes or decodes with one copy of a model, as planned.
ROWS = 100_000
#: Points that one task of training passes over, each as often as there are epochs.
AT_ONCE = 2_000_000
#: Partitions of training for each shuffle partition: few curves meet in one.
TASKS = 4


class ExternalDecoder(ABC):
    """gamma to scaled positions without training: made from an encoder and scaled points, and again when these change."""

    @abstractmethod
    def update(self, encoder: OrderingNet, ws: np.ndarray) -> ExternalDecoder:
        """The decoder for this encoder and these points (positions, then velocities)."""

    @abstractmethod
    def __call__(self, gamma: np.ndarray) -> np.ndarray: ...


@dataclass
class RunningMeanDecoder(ExternalDecoder):
    """gamma to the mean position of the members around it, 0 where there are none; beyond the gammas of all points that it
    was made from it is an error."""

    window_size: float = 0.05
    member_threshold: float = 0.5
    gamma: np.ndarray = field(default_factory=lambda: np.zeros(0))
    q: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bounds: tuple[float, float] | None = None

    @classmethod
    def make(cls, encoder: OrderingNet, ws: np.ndarray, window_size: float = 0.05, member_threshold: float = 0.5) -> RunningMeanDecoder:
        return cls(window_size, member_threshold).update(encoder, ws)

    def update(self, encoder: OrderingNet, ws: np.ndarray) -> RunningMeanDecoder:
        gamma, p = encoder(ws)
        use = p >= self.member_threshold
        return RunningMeanDecoder(self.window_size, self.member_threshold, gamma[use], ws[use, : ws.shape[1] // 2], (float(gamma.min()), float(gamma.max())) if len(gamma) else None)

    def __call__(self, gamma: np.ndarray) -> np.ndarray:
        if self.bounds is None:
            raise ValueError("the decoder has no points")
        if len(gamma) and (gamma.min() < self.bounds[0] or gamma.max() > self.bounds[1]):
            raise ValueError("gamma is outside the range of the points")
        return window_means(gamma, self.gamma, self.q, self.window_size)


@dataclass(frozen=True)
class PathAutoencoder:
    """Sizes of the networks of each curve; the same seed gives the same model."""

    gamma_range: tuple[float, float] = (-1.0, 1.0)
    encoder_size: tuple[int, int] = (100, 2)
    track_size: tuple[int, int] = (128, 3)
    n_freq: int = 0
    seed: int = 0

    def make(self, dims: int, membership: MixtureMembershipConfig | None):
        rng = np.random.default_rng(self.seed)
        encoder = OrderingNet(2 * dims, rng, *self.encoder_size, self.gamma_range)
        track = FourierTrackNet(dims, rng, self.n_freq, *self.track_size) if self.n_freq else TrackNet(dims, rng, *self.track_size)
        width = WidthNet(rng, sigma_init=membership.sigma_init, sigma_min=membership.sigma_min) if membership else None
        return encoder, track, width, rng


@dataclass(frozen=True)
class EncoderExternalDecoder:
    """A trained encoder with a decoder that isn't trained."""

    decoder: ExternalDecoder = field(default_factory=RunningMeanDecoder)
    gamma_range: tuple[float, float] = (-1.0, 1.0)
    encoder_size: tuple[int, int] = (100, 2)
    seed: int = 0


def train(df: DataFrame, result: DataFrame, spec: Spec, model: PathAutoencoder | EncoderExternalDecoder | None = None, config: TrainingConfig | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """stream, model, losses: a model for each stream, from its points and their order (stream, idx, ord).

    A task passes over ``at_once`` points, epochs counted, and then over no more: curves whose training needs more are
    handed from task to task, which changes nothing in their models.  One epoch is never split."""
    model, config = model or PathAutoencoder(), config or TrainingConfig()
    kind = df.schema[spec.stream].dataType.simpleString()
    dims = len(spec.q)
    external = isinstance(model, EncoderExternalDecoder)
    epochs = config.encoder.n_epochs + (0 if external else config.decoder.n_epochs + config.n_epochs_both)
    small, large = by_size(df, spec.stream, at_once // max(1, epochs))
    result = result if small is None or large is None else stored(result, "train-order")

    def begun(pdf: pd.DataFrame) -> tuple:
        pdf, q, v = checked(pdf, spec)
        ws = np.hstack([q, v])
        mean, std = ws.mean(axis=0), ws.std(axis=0) + 1e-8
        path = pdf.dropna(subset=["ord"]).sort_values("ord").index.to_numpy()
        if external:
            rng = np.random.default_rng(model.seed)
            nets = OrderingNet(2 * dims, rng, *model.encoder_size, model.gamma_range), None, None
        else:
            *nets, rng = model.make(dims, config.membership)
        return Course(*nets, (ws - mean) / std, path, config, rng), mean, std

    def ended(stream, course: Course, mean: np.ndarray, std: np.ndarray) -> pd.DataFrame:
        track = model.decoder.update(course.encoder, course.ws) if external else course.track
        made = {"encoder": course.encoder, "track": track, "width": course.width, "mean": mean, "std": std, "background": background_density(course.ws[:, :dims])}
        return pd.DataFrame({spec.stream: [stream], "model": [pickle.dumps(made)], "losses": [course.losses]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        course, *scale = begun(pdf)
        course.advance()
        return ended(pdf[spec.stream].iloc[0], course, *scale)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({spec.stream: [pdf[spec.stream].iloc[0]], "state": [pickle.dumps(begun(pdf))], "finished": [False]})

    def further(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stream, state in (row for pdf in parts for row in zip(pdf[spec.stream], pdf["state"], strict=True)):
            course, *scale = pickle.loads(state)
            course.advance(max(at_once, len(course.ws)))
            yield pd.DataFrame({spec.stream: [stream], "state": [pickle.dumps((course, *scale))], "finished": [course.finished]})

    def last(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stream, state in (row for pdf in parts for row in zip(pdf[spec.stream], pdf["state"], strict=True)):
            yield ended(stream, *pickle.loads(state))

    # Told a number, Spark doesn't put curves together by their bytes: training takes long for few of them.
    parts = TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = result.select(F.col(spec.stream).alias("_s"), F.col(spec.idx).alias("_i"), "ord")
    visited = lambda rows: spec.typed(rows).join(r, F.col(spec.stream).eqNullSafe(F.col("_s")) & (F.col(spec.idx) == F.col("_i")), "left").drop("_s", "_i").repartition(parts, spec.stream).groupBy(spec.stream)
    schema, state = f"`{spec.stream}` {kind}, model binary, losses array<double>", f"`{spec.stream}` {kind}, state binary, finished boolean"
    done = [] if small is None else [visited(small).applyInPandas(whole, schema)]
    if large is not None:
        with scratch(df.sparkSession) as keep:
            now = stored(visited(large).applyInPandas(first, state), "train-state")
            while left := now.where("not finished").count():
                # a curve to a task: partitions by range are of one row each
                new = stored(now.where("not finished").repartitionByRange(left, spec.stream).mapInPandas(further, state), "train-state")
                ready = new.where("finished")
                if n := ready.count():
                    done.append(keep(ready.repartitionByRange(n, spec.stream).mapInPandas(last, schema), "models"))
                discard(now)
                now = new
    return reduce(DataFrame.unionByName, done)


def external_models(df: DataFrame, encoders: DataFrame, spec: Spec, decoder: ExternalDecoder | None = None) -> DataFrame:
    """stream, model: the encoders of models (stream, model) with a decoder made from the points of df, which one task holds
    for each stream.  Rows of a stream without a model make none."""
    decoder = decoder or RunningMeanDecoder()

    def run(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(models) or not len(rows):
            return pd.DataFrame({spec.stream: pd.Series([], dtype=object), "model": pd.Series([], dtype=object)})
        rows, q, v = checked(rows, spec)
        made = pickle.loads(models["model"].iloc[0])
        made |= {"track": decoder.update(made["encoder"], (np.hstack([q, v]) - made["mean"]) / made["std"]), "width": None}
        return pd.DataFrame({spec.stream: [rows[spec.stream].iloc[0]], "model": [pickle.dumps(made)]})

    kind = df.schema[spec.stream].dataType.simpleString()
    return spec.typed(df).groupBy(spec.stream).cogroup(encoders.select(spec.stream, "model").groupBy(spec.stream)).applyInPandas(run, f"`{spec.stream}` {kind}, model binary")


def _applied(df: DataFrame, models: DataFrame, spec: Spec, run, schema: str) -> DataFrame:
    """run(model, rows) over groups of about ROWS rows of a stream; each group has a copy of the model."""
    sizes = df.groupBy(spec.stream).agg(F.ceil(F.count("*") / F.lit(ROWS)).cast("long").alias("_n"))
    sizes = sizes.withColumnRenamed(spec.stream, "_s")
    m = models.select(F.col(spec.stream).alias("_s1"), "model").join(sizes, F.col("_s1").eqNullSafe(F.col("_s")))
    m = m.select(F.col("_s1").alias(spec.stream), "model", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_k"))
    salted = df.join(sizes, F.col(spec.stream).eqNullSafe(F.col("_s"))).drop("_s").withColumn("_k", F.pmod(F.xxhash64(*df.columns), F.col("_n"))).drop("_n")

    def one(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        return run(pickle.loads(model["model"].iloc[0]) if len(model) else None, rows if len(model) else rows.iloc[:0])

    return salted.groupBy(spec.stream, "_k").cogroup(m.groupBy(spec.stream, "_k")).applyInPandas(one, schema)


def _encoded(spec: Spec, full: bool):
    dims = len(spec.q)

    def run(m, rows: pd.DataFrame) -> pd.DataFrame:
        out = {spec.stream: rows[spec.stream], spec.idx: rows[spec.idx]}
        if m is None or not len(rows):
            n = np.zeros(0)
            return pd.DataFrame(out | {"gamma": n, "prob": n} | ({"r2": n, "sigma": n, "background": n} if full else {}))
        ws = (rows[[*spec.q, *spec.v]].to_numpy(float) - m["mean"]) / m["std"]
        gamma, p = m["encoder"](ws)
        out |= {"gamma": gamma, "prob": p}
        if full:
            if m["width"] is None:
                raise ValueError("posterior membership needs a model trained with a mixture (TrainingConfig(membership=...))")
            out |= {"r2": ((ws[:, :dims] - m["track"](gamma)) ** 2).sum(axis=1), "sigma": m["width"](gamma), "background": m["background"]}
        return pd.DataFrame(out)

    return run


def encode(df: DataFrame, models: DataFrame, spec: Spec) -> DataFrame:
    """stream, idx, gamma, prob of each row."""
    kind = df.schema[spec.stream].dataType.simpleString()
    return _applied(spec.typed(df), models, spec, _encoded(spec, False), f"`{spec.stream}` {kind}, `{spec.idx}` long, gamma double, prob double")


def posterior(df: DataFrame, models: DataFrame, spec: Spec, background_density: float | None = None) -> DataFrame:
    """stream, idx, gamma, prob, posterior: membership by the fitted path, width and background (of scaled positions)."""
    kind = df.schema[spec.stream].dataType.simpleString()
    schema = f"`{spec.stream}` {kind}, `{spec.idx}` long, gamma double, prob double, r2 double, sigma double, background double"
    rows = _applied(spec.typed(df), models, spec, _encoded(spec, True), schema)
    bg = F.log(F.col("background") if background_density is None else F.lit(float(background_density)))
    return rows.select(spec.stream, spec.idx, "gamma", "prob", membership_responsibility(F.col("prob"), F.col("r2"), F.col("sigma"), bg, len(spec.q)).alias("posterior"))


def decode(gammas: DataFrame, models: DataFrame, spec: Spec, gamma_range: tuple[float, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """gammas (stream, columns to keep, gamma) with positions; with a range, a gamma outside it is an error."""
    keep = keep or []
    kind = lambda c: f"`{c}` {gammas.schema[c].dataType.simpleString()}, "

    def run(m, rows: pd.DataFrame) -> pd.DataFrame:
        g = rows["gamma"].to_numpy(float)
        if gamma_range is not None and len(g) and not ((g >= gamma_range[0]) & (g <= gamma_range[1])).all():
            raise ValueError(f"gamma must be in {gamma_range}")
        n = len(spec.q)
        q = m["track"](g) * m["std"][:n] + m["mean"][:n] if m is not None and len(g) else np.zeros((0, n))
        return pd.DataFrame({spec.stream: rows[spec.stream], **{c: rows[c] for c in keep}, "gamma": g, **{c: q[:, i] for i, c in enumerate(spec.q)}})

    return _applied(gammas.select(spec.stream, *keep, F.col("gamma").cast("double")), models, spec, run, "".join(map(kind, [spec.stream, *keep])) + "gamma double, " + ", ".join(f"`{c}` double" for c in spec.q))


def fill_gaps(encoded: DataFrame, spec: Spec, prob_threshold: float = 0.5) -> DataFrame:
    """stream, idx, ord of the rows that are likely members, by gamma: points that a walk has skipped take their places.

    Places are counted over ranges of gamma, so a curve may be of any length."""
    members = encoded.where(F.col("prob") >= prob_threshold).select(key_of(F.col(spec.stream)).alias("_k"), F.col("gamma").alias("_g"), F.col(spec.idx).alias("_i"))
    kind = encoded.schema[spec.stream].dataType
    return ranked(members, "_k", ["_g", "_i"], "ord").select(stream_of(F.col("_k"), kind).alias(spec.stream), F.col("_i").alias(spec.idx), "ord")


@dataclass(frozen=True)
class AutoencoderResult(Curve):
    """What training gives: models (stream, model, losses), gamma and membership of all rows (stream, idx, gamma, prob), and
    the order of those that count (stream, idx, ord).

    Called with gammas (stream, gamma), it decodes them; a gamma outside the range is an error.  With a path model the order
    is by gamma, of the rows whose membership is at least the threshold; with an external decoder it is the order given."""

    points: DataFrame
    models: DataFrame
    encoded: DataFrame
    order: DataFrame
    spec: Spec
    gamma_range: tuple[float, float] = (-1.0, 1.0)

    @classmethod
    def fit(cls, df: DataFrame, order: DataFrame, spec: Spec, model: PathAutoencoder | EncoderExternalDecoder | None = None, config: TrainingConfig | None = None) -> AutoencoderResult:
        """Trains a model for each stream from its points and their order, once, and encodes all rows."""
        model, config = model or PathAutoencoder(), config or TrainingConfig()
        models = stored(train(df, order, spec, model, config), "models")
        encoded = stored(encode(df, models, spec), "encoded")
        own = order if isinstance(model, EncoderExternalDecoder) else fill_gaps(encoded, spec, config.member_threshold)
        return cls(df, models, encoded, own, spec, model.gamma_range)

    def __call__(self, gammas: DataFrame) -> DataFrame:
        return decode(gammas, self.models, self.spec, self.gamma_range)

    @property
    def membership(self) -> DataFrame:
        """stream, idx, prob of each row."""
        return self.encoded.select(self.spec.stream, self.spec.idx, "prob")

    def filled(self, prob_threshold: float = 0.5) -> DataFrame:
        """stream, idx, ord of all likely members, skipped ones included, by gamma."""
        return fill_gaps(self.encoded, self.spec, prob_threshold)

    def posterior(self, background_density: float | None = None) -> DataFrame:
        return posterior(self.points, self.models, self.spec, background_density)
