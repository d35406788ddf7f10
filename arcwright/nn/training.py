"""Losses and the three phases of training: encoder, decoder, both together."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from arcwright.functions.mixture import EPS, MixtureMembershipConfig, membership_rampup, sigma_ceiling
from arcwright.operators.statistics import window_means

from .networks import AbstractTrack, AdamW, OrderingNet, WidthNet, sigmoid


@dataclass(frozen=True)
class EncoderConfig:
    n_epochs: int = 800
    batch_size: int = 100
    lambda_prob: float = 1.0
    arclength_alpha: float = 0.8


@dataclass(frozen=True)
class DecoderConfig:
    n_epochs: int = 100
    batch_size: int = 100


@dataclass(frozen=True)
class TrainingConfig:
    encoder: EncoderConfig = field(default_factory=EncoderConfig)
    decoder: DecoderConfig = field(default_factory=DecoderConfig)
    n_epochs_both: int = 200
    batch_size: int = 100
    lambda_q: float = 1.0
    lambda_p: tuple[float, float] = (1.0, 5.0)
    member_threshold: float = 0.5
    freeze_encoder: bool = False
    weight_by_density: bool = False
    membership: MixtureMembershipConfig | None = None
    #: Of the networks while they are trained, as the array library's default is; models are applied in double precision.
    precision: str = "float32"

    def __post_init__(self) -> None:
        if self.precision not in ("float32", "float64"):
            raise ValueError("precision must be float32 or float64")
        if not 0 <= self.member_threshold <= 1:
            raise ValueError("member_threshold must be in [0, 1]")


def batches(n: int, size: int, rng: np.random.Generator):
    order = rng.permutation(n)
    for a in range(0, n, size):
        yield order[a : a + size]


def targets(q: np.ndarray, gamma_range, alpha: float) -> np.ndarray:
    """gamma of points in order: rank and arc length, blended."""
    low, high = gamma_range
    rank = np.linspace(low, high, len(q))
    s = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(q, axis=0), axis=1))])
    arc = low + (high - low) * s / s[-1] if s[-1] > 0 else rank
    alpha = min(1.0, max(0.0, alpha))
    return (1 - alpha) * rank + alpha * arc


def box(ws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = ws.min(axis=0), ws.max(axis=0)
    e = np.where(high > low, high - low, 1.0)
    return low - 0.5 * e, high + 0.5 * e


def encoder_epochs(net: OrderingNet, adam: AdamW, ordered: np.ndarray, config: EncoderConfig, rng: np.random.Generator, n_epochs: int) -> list[float]:
    """Points in order are pulled to their gamma and to probability 1, uniform points of the box to probability 0."""
    gamma = targets(ordered[:, : ordered.shape[1] // 2], net.gamma_range, config.arclength_alpha)
    low, high = box(ordered)
    points = ordered.astype(net.dtype)
    losses = []
    for _ in range(n_epochs):
        random, total = rng.uniform(low, high, ordered.shape).astype(net.dtype), 0.0
        for rows in batches(len(ordered), config.batch_size, rng):
            n = len(rows)
            g, p, kept = net.forward(np.concatenate([points[rows], random[rows]]))
            dgamma, missed = np.zeros(2 * n), p.astype(float)
            off = np.subtract(g[:n], gamma[rows], out=dgamma[:n])
            missed[:n] -= 1
            total += (off @ off + config.lambda_prob * (missed @ missed)) / len(ordered)
            adam.step(net.backward(kept, 2 / n * dgamma, 2 * config.lambda_prob / n * missed))
        losses.append(total)
    return losses


def track_epochs(net: AbstractTrack, adam: AdamW, gamma: np.ndarray, q: np.ndarray, config: DecoderConfig, rng: np.random.Generator, n_epochs: int) -> list[float]:
    """Positions at gammas, by squared distance (weights 1 and 0.1 of position and direction, the latter without gradient)."""
    gamma, q = gamma.astype(net.dtype), q.astype(net.dtype)
    losses = []
    for _ in range(n_epochs):
        total = 0.0
        for rows in batches(len(gamma), config.batch_size, rng):
            x, kept = net.forward(gamma[rows])
            off = x - q[rows]
            total += float((off**2).sum()) / 1.1 / len(gamma)
            adam.step(net.backward(kept, 2 * off / len(rows) / 1.1)[1])
        losses.append(total)
    return losses


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def path_step(encoder: OrderingNet, track: AbstractTrack, ws, mask, weights, threshold, lambda_q, lambda_p) -> tuple[float, list, list]:
    """Loss and gradients of encoder and decoder: members under the threshold, others over it, and distances to the path."""
    dims, n = ws.shape[1] // 2, len(ws)
    gamma, p, kept = encoder.forward(ws)
    x, kept_x = track.forward(gamma)
    member = p > threshold
    missed, taken, use = mask & ~member, ~mask & member, mask & member
    loss = ((1 - p)[missed].sum() + p[taken].sum()) / n
    dp = (taken.astype(float) - missed) / n
    dq = np.zeros_like(x)
    if use.any():
        m, k = use.sum(), 1 / (lambda_q + lambda_p)
        off = (x - ws[:, :dims])[use]
        apart = ((_unit(track.tangent(gamma[use])) - _unit(ws[use, dims:])) ** 2).sum(axis=1)
        loss += k * (lambda_q * (weights[use] * (off**2).sum(axis=1)).sum() + lambda_p * (weights[use] * apart).sum()) / m
        dq[use] = 2 * k * lambda_q * weights[use, None] * off / m
    dgamma, d_track = track.backward(kept_x, dq)
    return float(loss), encoder.backward(kept, dgamma, dp), d_track


def mixture_step(encoder, track, width: WidthNet, ws, mask, log_background, ceiling, rampup, lambda_velocity, lambda_p) -> tuple[float, list, list, list]:
    """Loss and gradients of encoder, decoder and width: the mixture's negative log-likelihood, and the directions'
    distances weighted by responsibility (without gradient)."""
    dims = ws.shape[1] // 2
    gamma, p, kept = encoder.forward(ws)
    x, kept_x = track.forward(gamma)
    free, kept_s = width.forward(gamma)
    p, free = p.astype(float), free.astype(float)  # what each row has once costs nothing in double precision
    sigma = np.minimum(free, ceiling)
    off = (x - ws[:, :dims]).astype(float)
    r2 = (off**2).sum(axis=1)
    raw = 1 - rampup * (1 - p)
    eff = np.clip(raw, EPS, 1 - EPS)
    fg = np.log(eff) - 0.5 * r2 / sigma**2 - dims * np.log(sigma) - 0.5 * dims * np.log(2 * np.pi)
    bg = np.log1p(-eff) + log_background
    n = max(1, int(mask.sum()))
    loss = -(np.logaddexp(fg, bg) * mask).sum() / n
    r = sigmoid(fg - bg)
    a, b = -r * mask / n, -(1 - r) * mask / n
    dp = (a / eff - b / (1 - eff)) * rampup * ((raw > EPS) & (raw < 1 - EPS))
    dq = (-a / sigma**2)[:, None] * off
    dsigma = a * (r2 / sigma**3 - dims / sigma) * (free < ceiling)
    by_width, d_width = width.backward(kept_s, dsigma)
    by_track, d_track = track.backward(kept_x, dq)
    if lambda_velocity and (r * mask).sum() > 0:
        apart = ((_unit(track.tangent(gamma, kept_x)) - _unit(ws[:, dims:])) ** 2).sum(axis=1)
        loss += lambda_velocity * lambda_p * (r * mask * apart).sum() / (r * mask).sum()
    return float(loss), encoder.backward(kept, by_track + by_width, dp), d_track, d_width


def background_density(q: np.ndarray) -> float:
    e = q.max(axis=0) - q.min(axis=0)
    return float(1 / np.where(e > 0, e, 1.0).prod())


def density_weights(gamma: np.ndarray, bandwidth: float = 0.02) -> np.ndarray:
    return np.array([1 / np.exp(-0.5 * ((gamma - g) / bandwidth) ** 2).mean() for g in gamma])


def compute_uniform_weights(gamma: np.ndarray) -> np.ndarray:
    """A weight of one for each sample."""
    return np.ones(len(gamma))


def both_epochs(encoder, track, width, adam: AdamW, ws, mask, weights, config: TrainingConfig, rng, epochs: range) -> list[float]:
    mixture, n, dims = config.membership, config.n_epochs_both, ws.shape[1] // 2
    points = ws.astype(track.dtype)
    log_bg = 0.0
    if mixture:
        log_bg = np.log(background_density(ws[:, :dims])) if mixture.log_background_density is None else mixture.log_background_density
    losses = []
    for epoch in epochs:
        lambda_p = config.lambda_p[0] + (config.lambda_p[1] - config.lambda_p[0]) * (epoch / (n - 1) if n > 1 else 0.0)
        total = 0.0
        for rows in batches(len(ws), config.batch_size, rng):
            if mixture:
                ceiling = sigma_ceiling(epoch, n, *mixture.sigma_ceiling)
                loss, *grads = mixture_step(encoder, track, width, points[rows], mask[rows], log_bg, ceiling, membership_rampup(epoch, n, mixture.warmup_frac), mixture.lambda_velocity, lambda_p)
            else:
                loss, *grads = path_step(encoder, track, points[rows], mask[rows], weights[rows], config.member_threshold, config.lambda_q, lambda_p)
            adam.step([g for part in (grads[1:] if config.freeze_encoder else grads) for g in part])
            total += loss * len(rows) / len(ws)
        losses.append(total)
    return losses


class Course:
    """The three phases of training over scaled points in rows of ws, path: rows in the order of visits.

    It stops between epochs when told, and goes on after a pickle has taken it elsewhere, as if it hadn't stopped."""

    def __init__(self, encoder: OrderingNet, track: AbstractTrack | None, width: WidthNet | None, ws: np.ndarray, path: np.ndarray, config: TrainingConfig, rng: np.random.Generator) -> None:
        if len(path) == 0:
            raise ValueError("training needs visited points")
        self.encoder, self.track, self.width, self.ws, self.path, self.config, self.rng = encoder, track, width, ws, path, config, rng
        self.losses: list[float] = []
        self.phase, self.at, self.adam = 0, 0, None
        self.mask = self.weights = None
        self._to(config.precision)

    def _to(self, precision: str) -> None:
        for net in (self.encoder, self.track, self.width):
            if net is not None:
                net.to(precision)

    @property
    def finished(self) -> bool:
        return self.phase == (1 if self.track is None else 3)

    def advance(self, most: float = float("inf")) -> None:
        """Epochs over up to so many points, one epoch at least."""
        while not self.finished:
            parameters, size, epochs, run = (self._encoder, self._track, self._both)[self.phase]()
            if self.adam is None:
                self.adam = AdamW(parameters)
            count = int(min(epochs - self.at, most // size if size else epochs))
            if epochs > self.at and count < 1:
                return
            with np.errstate(over="ignore"):
                self.losses += run(range(self.at, self.at + count))
            self.at, most = self.at + count, most - count * size
            if self.at < epochs:
                return
            self.phase, self.at, self.adam = self.phase + 1, 0, None
            if self.finished:
                self._to("float64")

    def _encoder(self):
        c = self.config.encoder
        run = lambda epochs: encoder_epochs(self.encoder, self.adam, self.ws[self.path], c, self.rng, len(epochs))
        return self.encoder.parameters, len(self.path), c.n_epochs, run

    def _track(self):
        c, dims = self.config, self.ws.shape[1] // 2
        gamma = np.full(len(self.ws), self.encoder.gamma_range[0])
        gamma[self.path] = np.linspace(*self.encoder.gamma_range, len(self.path))
        use = np.zeros(len(self.ws), bool)
        use[self.path] = True
        use &= self.encoder(self.ws)[1] > c.member_threshold
        gamma, q = gamma[use], self.ws[use, :dims]
        run = lambda epochs: track_epochs(self.track, self.adam, gamma, window_means(gamma, gamma, q, 0.05), c.decoder, self.rng, len(epochs))
        return self.track.parameters, len(gamma), c.decoder.n_epochs if len(gamma) else 0, run

    def _both(self):
        c = self.config
        if self.mask is None:  # as the first phase has left them
            gamma, p = self.encoder(self.ws)
            self.mask = np.ones(len(p), bool) if c.membership else p > c.member_threshold
            self.weights = density_weights(gamma) if c.weight_by_density and not c.membership else compute_uniform_weights(gamma)
        nets = [self.track] if c.freeze_encoder else [self.encoder, self.track]
        parameters = [p for net in nets for p in net.parameters] + (self.width.parameters if c.membership else [])
        run = lambda epochs: both_epochs(self.encoder, self.track, self.width, self.adam, self.ws, self.mask, self.weights, c, self.rng, epochs)
        return parameters, len(self.ws), c.n_epochs_both if self.mask.any() else 0, run


def train_all(encoder, track, width, ws: np.ndarray, path: np.ndarray, config: TrainingConfig, rng) -> list[float]:
    """A course at a stretch.  The losses of all epochs."""
    course = Course(encoder, track, width, ws, path, config, rng)
    course.advance()
    return course.losses
