"""Distance metrics between the current point of a walk and candidates: as columns and as arrays.

A metric of one's own is a subclass with either form, or both.  With ``bound`` as well, a walk searches a tree; without
it, a step looks at all points that are left.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phasespace as P


#: Of the corners of a box in position (low, high) and in velocity (low, high).
Bound = Callable[[tuple[float, ...], tuple[float, ...], tuple[float, ...], tuple[float, ...]], float]
#: What rounding takes from a bound.
SLACK = 1e-12


class Metric(ABC):
    #: Whether reversing velocities can change a distance.
    directed = True

    @abstractmethod
    def column(self, q0: P.Vector, v0: P.Vector, q: P.Vector, v: P.Vector, scale: float) -> Column:
        """Distance from (q0, v0) to (q, v)."""

    @abstractmethod
    def array(self, q0: np.ndarray, v0: np.ndarray, q: np.ndarray, v: np.ndarray, scale: float) -> np.ndarray:
        """Distances from one point to the rows of q and v."""

    def bound(self, q0: np.ndarray, v0: np.ndarray, scale: float) -> Bound | None:
        """What gives a number that no distance to a point in a box is under, or None."""
        return None


def box_distance(at: tuple[float, ...], low: tuple[float, ...], high: tuple[float, ...]) -> float:
    total = 0.0
    for x, a, b in zip(at, low, high):
        gap = a - x if x < a else x - b if x > b else 0.0
        total += gap * gap
    return math.sqrt(total)


class Spatial(Metric):
    """Distance of positions."""

    directed = False

    def column(self, q0, v0, q, v, scale):
        return P.euclidean_distance(q0, q)

    def array(self, q0, v0, q, v, scale):
        return lengths(q - q0)

    def bound(self, q0, v0, scale):
        at = tuple(q0.tolist())
        return lambda low, high, _, __: box_distance(at, low, high) * (1 - SLACK)


class AlignedMomentum(Metric):
    """Distance of positions, and scale * (1 - cosine) between the current velocity and the direction of the candidate.

    A candidate at the current position has no direction, so its distance is the scale.
    """

    def column(self, q0, v0, q, v, scale):
        return P.euclidean_distance(q0, q) + F.lit(float(scale)) * (F.lit(1.0) - P.dot(P.unit_velocity(v0), P.unit_direction(q0, q)))

    def array(self, q0, v0, q, v, scale):
        d = q - q0
        n = lengths(d)
        speed = lengths(v0[None])[0]
        u = v0 / speed if speed else np.zeros_like(v0)
        cosine = ordered_sum((u * np.divide(d, n[:, None], out=np.zeros_like(d), where=n[:, None] != 0)).T)
        return n + scale * (1.0 - cosine)

    def bound(self, q0, v0, scale):
        """The distance of the box, and the least angle between the velocity and a ball around the box."""
        at, speed = tuple(q0.tolist()), float(lengths(v0[None])[0])
        u = tuple((v0 / speed).tolist()) if speed else None

        def of(low, high, _, __):
            near, least = box_distance(at, low, high), min(0.0, 2.0 * scale)
            if u is None:
                least = scale  # no direction: the cosine is 0
            elif scale > 0:
                along = far = ball = 0.0
                for x, a, b, c in zip(at, low, high, u):
                    d = 0.5 * (a + b) - x
                    along += d * c
                    far += d * d
                    ball += (b - a) * (b - a)
                far, ball = math.sqrt(far), 0.5 * math.sqrt(ball)
                if far > ball * (1 + SLACK):
                    angle = math.acos(max(-1.0, min(1.0, along / far))) - math.asin(min(1.0, ball / far))
                    least = scale * (1.0 - math.cos(angle)) if angle > 0 else 0.0
            return near + least - SLACK * (near + 4.0 * abs(scale))

        return of


class FullPhaseSpace(Metric):
    """Root of the squared distance of positions and the squared, scaled distance of velocities."""

    directed = False

    def column(self, q0, v0, q, v, scale):
        d, w = P.euclidean_distance(q0, q), F.lit(float(scale)) * P.euclidean_distance(v0, v)
        return F.sqrt(d * d + w * w)

    def array(self, q0, v0, q, v, scale):
        d, w = lengths(q - q0), scale * lengths(v - v0)
        return np.sqrt(d * d + w * w)

    def bound(self, q0, v0, scale):
        at, speed = tuple(q0.tolist()), tuple(v0.tolist())

        def of(low, high, slow, fast):
            d, w = box_distance(at, low, high), scale * box_distance(speed, slow, fast)
            return math.sqrt(d * d + w * w) * (1 - SLACK)

        return of


def ordered_sum(terms: np.ndarray) -> np.ndarray:
    """Terms added from first to last, as the columns of an expression are."""
    out = terms[0].copy()
    for t in terms[1:]:
        out += t
    return out


def lengths(d: np.ndarray) -> np.ndarray:
    return np.sqrt(ordered_sum((d * d).T))
