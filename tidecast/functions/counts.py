"""Negative binomial draws for whole batches: numpy only, each number a function of its key and place alone.

Uniform numbers come from a counter (a hash of key, place, stream), so that a draw doesn't depend on which rows share its
batch or task. Gamma variates are drawn by Marsaglia and Tsang's method, Poisson ones by Hoermann's transformed rejection
(by inversion below a mean of ten); what is rejected is drawn again from the next streams, all at once.
"""

from __future__ import annotations

import math

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STREAMS = np.uint64(1 << 12)
_LOG_FACTORIAL = np.array([math.lgamma(k + 1) for k in range(16)])


def uniforms(key: np.ndarray, place: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) from keys and places (uint64)."""
    x = key + _GOLDEN * (place * _STREAMS + np.uint64(stream + 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def log_factorial(k: np.ndarray) -> np.ndarray:
    x = np.maximum(k, 15.0) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(k < 16, _LOG_FACTORIAL[np.clip(k, 0, 15).astype(int)], series)


def gamma(shape: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Gamma variates of scale one."""
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    out, todo, stream = np.empty(len(shape)), np.arange(len(shape)), 1
    while len(todo):
        a, b, u = (uniforms(key[todo], place[todo], stream + s) for s in range(3))
        x, dt = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b), d[todo]
        v = (1 + x / np.sqrt(9 * dt)) ** 3
        safe = np.where(v > 0, v, 1.0)
        good = (v > 0) & (np.log(u) < 0.5 * x * x + dt - dt * safe + dt * np.log(safe))
        out[todo[good]] = dt[good] * v[good]
        todo, stream = todo[~good], stream + 3
    small = shape < 1
    out[small] *= uniforms(key[small], place[small], 0) ** (1 / shape[small])
    return out


def poisson(mean: np.ndarray, key: np.ndarray, place: np.ndarray, stream: int = 1024) -> np.ndarray:
    out = np.zeros(len(mean))
    low = np.flatnonzero(mean < 10)
    u, term = uniforms(key[low], place[low], stream), np.exp(-mean[low])
    todo, reached, k = np.arange(len(low)), term.copy(), 0
    while len(todo := todo[(u[todo] > reached[todo]) & (k < 200)]):
        k += 1
        term[todo] *= mean[low[todo]] / k
        reached[todo] += term[todo]
        out[low[todo]] = k
    todo = np.flatnonzero(mean >= 10)
    while len(todo):
        m = mean[todo]
        b = 0.931 + 2.53 * np.sqrt(m)
        a = -0.059 + 0.02483 * b
        u, v = uniforms(key[todo], place[todo], stream) - 0.5, uniforms(key[todo], place[todo], stream + 1)
        us = 0.5 - np.abs(u)
        k = np.floor((2 * a / us + b) * u + m + 0.43)
        quick = (us >= 0.07) & (v <= 0.9277 - 3.6224 / (b - 2))
        bad = (k < 0) | ((us < 0.013) & (v > us))
        inverse = 1.1239 + 1.1328 / (b - 3.4)
        exact = np.log(v * inverse / (a / (us * us) + b)) <= k * np.log(m) - m - log_factorial(np.maximum(k, 0))
        good = quick | (~bad & exact)
        out[todo[good]] = k[good]
        todo, stream = todo[~good], stream + 2
    return out


def negative_binomial(mean: np.ndarray, dispersion: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Counts of the given mean and variance mean + dispersion * mean^2."""
    return poisson(mean * dispersion * gamma(1 / dispersion, key, place), key, place)


def segment_quantiles(values: np.ndarray, sizes: np.ndarray, levels: list[float]) -> np.ndarray:
    """Linearly interpolated quantiles of consecutive segments of the given sizes, a row each; missing for empty ones."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ordered = np.append(values[np.lexsort((values, owner))], 0.0)
    at = (np.cumsum(sizes) - sizes)[:, None]
    rank = np.asarray(levels)[None, :] * np.maximum(sizes - 1, 0)[:, None]
    low = np.floor(rank).astype(int)
    a, b = ordered[at + low], ordered[at + np.ceil(rank).astype(int)]
    return np.where(sizes[:, None] > 0, a + (b - a) * (rank - low), np.nan)
