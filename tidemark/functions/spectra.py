"""Lomb-Scargle power, frequency grids, peaks."""

from __future__ import annotations

import math

import numpy as np


def grid_of(t: np.ndarray, resolution: float = 10.0, max_freq_factor: float = 1.0, nyquist: str | float = "average") -> np.ndarray:
    """Angular frequencies: steps of ``2 pi / (resolution * T)`` up to a multiple of Nyquist's frequency."""
    span, steps = float(t[-1] - t[0]), np.diff(t)
    if nyquist == "average":
        top = math.pi * (len(t) - 1) / span
    elif nyquist == "median":
        top = math.pi / float(np.median(steps))
    else:
        top = math.pi / float(np.quantile(steps, nyquist))
    step = 2 * math.pi / (resolution * span)
    return step * np.arange(1, max(1, math.ceil(top * max_freq_factor / step)) + 1)


def power(t: np.ndarray, m: np.ndarray, freqs: np.ndarray, block: int = 4096) -> np.ndarray:
    """Normalised power of the standardised series (ddof 1) at angular frequencies, directly."""
    t = np.asarray(t, float)
    y = np.asarray(m, float)
    std = y.std(ddof=1)
    y = (y - y.mean()) / std if std > 0 else np.zeros(len(y))
    out = np.empty(len(freqs))
    size = max(1, block * 64 // max(len(t), 1))
    for a in range(0, len(freqs), size):
        w = freqs[a : a + size, None]
        c, s = np.cos(w * t), np.sin(w * t)
        cc, ss, cs = (c * c).sum(1), (s * s).sum(1), (c * s).sum(1)
        yc, ys = c @ y, s @ y
        tau = 0.5 * np.arctan2(2 * cs, cc - ss)
        ct, st = np.cos(tau), np.sin(tau)
        nc, ns = yc * ct + ys * st, ys * ct - yc * st
        dc, ds = ct * ct * cc + 2 * ct * st * cs + st * st * ss, ct * ct * ss - 2 * ct * st * cs + st * st * cc
        tiny = 1e-12 * len(t)
        out[a : a + size] = 0.5 * (np.where(dc > tiny, nc**2 / np.maximum(dc, tiny), 0) + np.where(ds > tiny, ns**2 / np.maximum(ds, tiny), 0))
    return out


def _spread(values: np.ndarray, at: np.ndarray, size: int, order: int = 4) -> np.ndarray:
    """Values at fractional places put on a grid by Lagrange weights of ``order`` neighbours."""
    grid = np.zeros(size)
    low = np.floor(at).astype(int) - order // 2 + 1
    for k in range(order):
        weight = np.ones(len(at))
        for j in range(order):
            if j != k:
                weight *= (at - low - j) / (k - j)
        np.add.at(grid, (low + k) % size, values * weight)
    return grid


def fast_power(t: np.ndarray, m: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Like :func:`power` by one FFT of extirpolated values, for frequencies that are multiples of their step from 0 or the step on."""
    step = freqs[1] - freqs[0] if len(freqs) > 1 else freqs[0]
    first = int(round(freqs[0] / step))
    y = np.asarray(m, float)
    std = y.std(ddof=1)
    if not std > 0:
        return np.zeros(len(freqs))
    y = (y - y.mean()) / std
    top = first + len(freqs)
    size = 1 << math.ceil(math.log2(16 * top))
    x = (np.asarray(t, float) - t[0]) * step / (2 * math.pi) * size
    one = lambda v, at: np.conj(np.fft.rfft(_spread(v, at % size, size)))
    fy, f2 = one(y, x)[first:top], one(np.ones(len(y)), 2 * x)[first:top]
    n = len(y)
    cc, ss, cs = 0.5 * (n + f2.real), 0.5 * (n - f2.real), 0.5 * f2.imag
    tau = 0.5 * np.arctan2(2 * cs, cc - ss)
    ct, st = np.cos(tau), np.sin(tau)
    nc, ns = fy.real * ct + fy.imag * st, fy.imag * ct - fy.real * st
    dc, ds = ct * ct * cc + 2 * ct * st * cs + st * st * ss, ct * ct * ss - 2 * ct * st * cs + st * st * cc
    tiny = 1e-9 * n
    return 0.5 * (np.where(dc > tiny, nc**2 / np.maximum(dc, tiny), 0) + np.where(ds > tiny, ns**2 / np.maximum(ds, tiny), 0))


def normalised(p: np.ndarray, n: int, how: str) -> np.ndarray:
    """``psd`` as it is; ``standard`` between 0 and 1; ``model`` s/(1-s); ``log`` -ln(1-s)."""
    if how == "psd":
        return p
    s = np.minimum(2 * p / max(n - 1, 1), 1 - 1e-15)
    return {"standard": lambda: s, "model": lambda: s / (1 - s), "log": lambda: -np.log1p(-s)}[how]()


def peaks(freqs: np.ndarray, p: np.ndarray, count: int) -> list[float]:
    """Period and signal to noise of the ``count`` strongest local maxima; zeros where there are fewer."""
    padded = np.concatenate([[-np.inf], p, [-np.inf]])
    top = np.flatnonzero((p > padded[:-2]) & (p >= padded[2:]) & (freqs > 0))
    top = top[np.argsort(-p[top], kind="stable")][:count]
    noise = p.std()
    out = [v for k in top for v in (2 * math.pi / freqs[k], (p[k] - p.mean()) / noise if noise > 0 else 0.0)]
    return out + [0.0] * (2 * count - len(out))
