"""Multi-layer perceptrons with hand-written gradients, and the networks made of them."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np


def _tanh(z: np.ndarray) -> np.ndarray:
    """In place.  In single precision by the exponential, which numpy vectorises where it doesn't vectorise tanh; beyond
    its range it is infinite, which gives 1."""
    if z.dtype != np.float32:
        return np.tanh(z, out=z)
    z += z
    np.exp(z, out=z)
    z += 1
    np.divide(-2, z, out=z)
    z += 1
    return z


def _slopes(tanh: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """grad times the derivative of tanh, given its values."""
    out = tanh * tanh
    np.subtract(1, out, out=out)
    out *= grad
    return out


class Perceptron:
    """Layers of tanh; the last one is linear unless ``bounded``.  It computes in the precision of its inputs and weights."""

    def __init__(self, sizes: list[int], rng: np.random.Generator, bounded: bool = False) -> None:
        self.bounded = bounded
        self.w = [rng.uniform(-1, 1, (a, b)) / np.sqrt(a) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        self.b = [rng.uniform(-1, 1, b) / np.sqrt(a) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]

    @property
    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.b]

    @property
    def dtype(self) -> np.dtype:
        return self.w[0].dtype

    def to(self, dtype) -> None:
        self.w, self.b = ([p.astype(dtype) for p in part] for part in (self.w, self.b))

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The input and the outputs of all layers."""
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = out[-1] @ w
            z += b
            out.append(_tanh(z) if self.bounded or i < len(self.w) - 1 else z)
        return out

    def backward(self, layers: list[np.ndarray], grad: np.ndarray, inner: bool = True) -> tuple[np.ndarray | None, list[np.ndarray]]:
        """Gradients of the input, if it is wanted, and of the parameters, from that of the output."""
        dw, db = [], []
        grad = grad.astype(self.dtype, copy=False)
        for i in range(len(self.w) - 1, -1, -1):
            if self.bounded or i < len(self.w) - 1:
                grad = _slopes(layers[i + 1], grad)
            dw.append(layers[i].T @ grad)
            db.append(np.ones(len(grad), grad.dtype) @ grad)
            grad = grad @ self.w[i].T if i or inner else None
        return grad, [*dw[::-1], *db[::-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class OrderingNet:
    """Phase-space points to gamma, within gamma_range, and a membership probability."""

    def __init__(self, in_size: int, rng: np.random.Generator, width: int = 100, depth: int = 2, gamma_range=(-1.0, 1.0)) -> None:
        self.gamma_range = gamma_range
        self.body = Perceptron([in_size, *[width] * (depth + 1)], rng, bounded=True)
        self.heads = Perceptron([width, 2], rng)

    @property
    def parameters(self):
        return [*self.body.parameters, *self.heads.parameters]

    @property
    def dtype(self) -> np.dtype:
        return self.body.dtype

    def to(self, dtype) -> None:
        self.body.to(dtype)
        self.heads.to(dtype)

    def forward(self, ws: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        body = self.body.forward(ws)
        heads = self.heads.forward(body[-1])
        t, p = np.tanh(heads[-1][:, 0]), sigmoid(heads[-1][:, 1])
        low, high = self.gamma_range
        return low + (high - low) * (t + 1) / 2, p, (body, heads, t, p)

    def __call__(self, ws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.forward(ws)[:2]

    def backward(self, kept: tuple, dgamma: np.ndarray, dp: np.ndarray) -> list[np.ndarray]:
        body, heads, t, p = kept
        low, high = self.gamma_range
        grad = np.stack([dgamma * (high - low) / 2 * (1 - t * t), dp * p * (1 - p)], axis=1)
        inner, dh = self.heads.backward(heads, grad)
        return [*self.body.backward(body, inner, False)[1], *dh]


class AbstractTrack(ABC):
    """gamma to positions, with the derivative by gamma."""

    out_size: int

    @abstractmethod
    def features(self, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the perceptron and their derivatives by gamma."""

    mlp: Perceptron

    @property
    def parameters(self):
        return self.mlp.parameters

    @property
    def dtype(self) -> np.dtype:
        return self.mlp.dtype

    def to(self, dtype) -> None:
        self.mlp.to(dtype)

    def forward(self, gamma: np.ndarray) -> tuple[np.ndarray, tuple]:
        x, dx = self.features(gamma)
        layers = self.mlp.forward(x)
        return layers[-1], (layers, dx)

    def __call__(self, gamma: np.ndarray) -> np.ndarray:
        return self.forward(gamma)[0]

    def tangent(self, gamma: np.ndarray, kept: tuple | None = None) -> np.ndarray:
        layers, d = self.forward(gamma)[1] if kept is None else kept
        for i, w in enumerate(self.mlp.w):
            d = d @ w
            if i < len(self.mlp.w) - 1:
                d = _slopes(layers[i + 1], d)
        return d

    def backward(self, kept: tuple, dq: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        layers, dx = kept
        inner, params = self.mlp.backward(layers, dq)
        return (inner * dx).sum(axis=1), params


class TrackNet(AbstractTrack):
    def __init__(self, out_size: int, rng: np.random.Generator, width: int = 100, depth: int = 3) -> None:
        self.out_size, self.mlp = out_size, Perceptron([1, *[width] * depth, out_size], rng)

    def features(self, gamma):
        return gamma[:, None], np.ones((len(gamma), 1), gamma.dtype)


class FourierTrackNet(AbstractTrack):
    """As TrackNet, on gamma and sines and cosines of pi k gamma."""

    def __init__(self, out_size: int, rng: np.random.Generator, n_freq: int = 8, width: int = 128, depth: int = 3) -> None:
        self.out_size, self.k = out_size, np.pi * np.arange(1, n_freq + 1)
        self.mlp = Perceptron([1 + 2 * n_freq, *[width] * depth, out_size], rng)

    def features(self, gamma):
        k = self.k.astype(gamma.dtype)
        a = gamma[:, None] * k
        return np.hstack([gamma[:, None], np.sin(a), np.cos(a)]), np.hstack([np.ones((len(gamma), 1), gamma.dtype), k * np.cos(a), -k * np.sin(a)])


class WidthNet:
    """gamma to the curve's width: sigma_min + exp of a perceptron that starts as the constant sigma_init."""

    def __init__(self, rng: np.random.Generator, width: int = 32, depth: int = 2, sigma_init: float = 0.1, sigma_min: float = 1e-3) -> None:
        if min(width, depth, sigma_init, sigma_min) <= 0:
            raise ValueError("sizes and widths must be positive")
        self.sigma_min, self.mlp = sigma_min, Perceptron([1, *[width] * depth, 1], rng)
        self.mlp.w[-1][:] = 0
        self.mlp.b[-1][:] = np.log(sigma_init)

    @property
    def parameters(self):
        return self.mlp.parameters

    def to(self, dtype) -> None:
        self.mlp.to(dtype)

    def forward(self, gamma: np.ndarray) -> tuple[np.ndarray, tuple]:
        layers = self.mlp.forward(gamma[:, None])
        raw = layers[-1][:, 0]
        e = np.exp(np.clip(raw, -20, 20))
        return self.sigma_min + e, (layers, e * (np.abs(raw) < 20))

    def __call__(self, gamma: np.ndarray) -> np.ndarray:
        return self.forward(gamma)[0]

    def backward(self, kept: tuple, dsigma: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        layers, slope = kept
        inner, params = self.mlp.backward(layers, (dsigma * slope)[:, None])
        return inner[:, 0], params


class AdamW:
    """Changes parameters in place.  Sums of gradients (m) and of their squares (s) are weighted by 0.9 and 0.999 a step.
    Long parameters are taken one at a time, short ones together: a call costs as much as thousands of numbers."""

    LONG = 4096
    #: Sums below this count as 0, in every so many steps: where a gradient stays 0 they would become subnormal, which is slow.
    #: Beside 1e-8 and in single precision they change nothing.
    NOTHING, STEPS = 1e-30, 64

    def __init__(self, parameters: list[np.ndarray], rate: float = 1e-3, decay: float = 1e-7) -> None:
        self.p, self.rate, self.decay, self.t = parameters, rate, decay, 0
        short = [i for i, p in enumerate(parameters) if p.size < self.LONG]
        self.groups = [[i] for i in range(len(parameters)) if i not in short] + ([short] if short else [])
        self.m, self.s = ([np.zeros_like(self._flat(parameters, group)) for group in self.groups] for _ in range(2))

    @staticmethod
    def _flat(parts: list[np.ndarray], group: list[int]) -> np.ndarray:
        return parts[group[0]].ravel() if len(group) == 1 else np.concatenate([parts[i].ravel() for i in group])

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for group, m, s in zip(self.groups, self.m, self.s, strict=True):
            if self.t % self.STEPS == 0:
                m[np.abs(m) < self.NOTHING] = 0
                s[s < self.NOTHING] = 0
            g = self._flat(grads, group)
            m *= 0.9
            m += g
            u = g * g
            s *= 0.999
            s += u
            np.multiply(s, 0.001 / (1 - 0.999**self.t), out=u)
            np.sqrt(u, out=u)
            u += 1e-8
            np.divide(m, u, out=u)
            u *= 0.1 / (1 - 0.9**self.t)
            u += self._flat(self.p, group) * self.decay
            u *= self.rate
            at = 0
            for i in group:
                p = self.p[i]
                p -= u[at : at + p.size].reshape(p.shape)
                at += p.size
