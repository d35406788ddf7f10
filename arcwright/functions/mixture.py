"""Mixture of a curve of Gaussian width and a uniform background, and the schedules of its training."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phasespace import logaddexp

EPS = 1e-6


def sigma_ceiling(epoch: int, n: int, start: float = 0.5, stop: float = 0.1) -> float:
    """From start to stop by equal factors over n epochs."""
    if start <= 0 or stop <= 0:
        raise ValueError("start and stop must be positive")
    return start if n <= 1 else start * (stop / start) ** (epoch / (n - 1))


def membership_rampup(epoch: int, n: int, warmup_frac: float = 0.3) -> float:
    """From 0 to 1 over the given share of n epochs, then 1."""
    if not 0 <= warmup_frac < 1:
        raise ValueError("warmup_frac must be in [0, 1)")
    return 1.0 if warmup_frac == 0 or n <= 1 else min(1.0, max(0.0, epoch / (warmup_frac * (n - 1))))


def sigma_ceiling_column(epoch: Column, n: int, start: float = 0.5, stop: float = 0.1) -> Column:
    sigma_ceiling(0, n, start, stop)
    return F.lit(float(start)) if n <= 1 else F.lit(float(start)) * F.pow(F.lit(stop / start), epoch / F.lit(n - 1))


def membership_rampup_column(epoch: Column, n: int, warmup_frac: float = 0.3) -> Column:
    membership_rampup(0, n, warmup_frac)
    return F.lit(1.0) if warmup_frac == 0 or n <= 1 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), epoch / F.lit(warmup_frac * (n - 1))))


def log_foreground_density(r2: Column, sigma: Column, dims: int) -> Column:
    return F.lit(-0.5) * r2 / (sigma * sigma) - F.lit(float(dims)) * F.log(sigma) - F.lit(0.5 * dims * math.log(2 * math.pi))


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def _logs(p: Column, r2: Column, sigma: Column, log_background: Column, dims: int) -> tuple[Column, Column]:
    p = _clipped(p)
    return F.log(p) + log_foreground_density(r2, sigma, dims), F.log1p(-p) + log_background


def membership_responsibility(p: Column, r2: Column, sigma: Column, log_background: Column, dims: int) -> Column:
    """Posterior probability that the point belongs to the curve, prior p."""
    fg, bg = _logs(p, r2, sigma, log_background, dims)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(bg - fg))


def log_likelihood(p: Column, r2: Column, sigma: Column, log_background: Column, dims: int, rampup: float = 1.0) -> Column:
    """Log-likelihood of a point; the mean of its negative is the mixture loss."""
    fg, bg = _logs(F.lit(1.0) - F.lit(float(rampup)) * (F.lit(1.0) - p), r2, sigma, log_background, dims)
    return logaddexp(fg, bg)


def mixture_loss(rows: DataFrame, keys: list[str], likelihood: Column, mask: Column) -> DataFrame:
    """keys, loss: the mean of the negative log-likelihoods where mask holds; 0 where it holds for none."""
    return rows.groupBy(*keys).agg(F.coalesce(-F.avg(F.when(mask, likelihood)), F.lit(0.0)).alias("loss"))


@dataclass(frozen=True)
class MixtureMembershipConfig:
    sigma_init: float = 0.1
    sigma_min: float = 1e-3
    sigma_ceiling: tuple[float, float] = (0.5, 0.1)
    warmup_frac: float = 0.3
    lambda_velocity: float = 1.0
    log_background_density: float | None = None

    def __post_init__(self) -> None:
        if min(self.sigma_init, self.sigma_min, *self.sigma_ceiling) <= 0:
            raise ValueError("widths must be positive")
        if not 0 <= self.warmup_frac < 1:
            raise ValueError("warmup_frac must be in [0, 1)")
        if self.lambda_velocity < 0:
            raise ValueError("lambda_velocity must not be negative")
