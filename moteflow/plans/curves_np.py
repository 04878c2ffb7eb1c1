"""Smoothing curves through a scan's plane medians (one small table per scan)."""

from __future__ import annotations

import numpy as np


def second_derivatives(h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the natural cubic spline through (knots, y)."""
    n = len(y)
    Q, R = _bands(h)
    m = np.zeros(n)
    m[1:-1] = np.linalg.solve(R, Q.T @ y)
    return m


def _bands(h: np.ndarray):
    n = len(h) + 1
    Q, R = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        Q[j, j], Q[j + 1, j], Q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        R[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            R[j, j - 1] = R[j - 1, j] = h[j] / 6
    return Q, R


def smooth_values(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Values at the knots of the weighted natural cubic smoothing spline whose smoothness minimizes
    generalized cross-validation."""
    Q, R = _bands(np.diff(x))
    K = Q @ np.linalg.solve(R, Q.T)
    s = np.sqrt(w)
    lam, U = np.linalg.eigh(K / np.outer(s, s))  # one decomposition serves every smoothness
    lam = np.maximum(lam, 0)
    c = U.T @ (s * y)

    def score(p: float) -> float:
        shrink = p * lam / (1 + p * lam)
        return ((shrink * c) ** 2).sum() / max(shrink.sum(), 1e-12) ** 2

    grid = np.exp(np.linspace(np.log(1e-9), np.log(1e9), 181)) / max(np.median(lam[lam > 0]) if (lam > 0).any() else 1.0, 1e-12)
    k = int(np.argmin([score(p) for p in grid]))
    a, b = np.log(grid[max(k - 1, 0)]), np.log(grid[min(k + 1, len(grid) - 1)])
    g = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        u, v = b - g * (b - a), a + g * (b - a)
        a, b = (a, v) if score(np.exp(u)) < score(np.exp(v)) else (u, b)
    p = np.exp((a + b) / 2)
    return (U @ (c / (1 + p * lam))) / s


def evaluate(x: np.ndarray, y: np.ndarray, m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, derivative) of a cubic spline given by knots, values and second derivatives."""
    j = np.clip(np.searchsorted(x, q, "right") - 1, 0, len(x) - 2)
    h = x[j + 1] - x[j]
    a, b = (x[j + 1] - q) / h, (q - x[j]) / h
    v = a * y[j] + b * y[j + 1] + ((a ** 3 - a) * m[j] + (b ** 3 - b) * m[j + 1]) * h ** 2 / 6
    d = (y[j + 1] - y[j]) / h + ((1 - 3 * a ** 2) * m[j] + (3 * b ** 2 - 1) * m[j + 1]) * h / 6
    return v, d


def monotone(x: np.ndarray, y: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape-preserving cubic through few points: harmonic-mean slopes, zero at turns."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    s = np.empty(len(x))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        s[1:-1] = np.where(d[:-1] * d[1:] > 0, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
    for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))) if len(h) > 1 else ():
        e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        s[end] = 0.0 if e * d0 <= 0 else 3 * d0 if d0 * d1 < 0 and abs(e) > 3 * abs(d0) else e
    if len(h) == 1:
        s[:] = d[0]
    j = np.clip(np.searchsorted(x, q, "right") - 1, 0, len(x) - 2)
    t, hh = (q - x[j]) / h[j], h[j]
    v = (2 * t ** 3 - 3 * t ** 2 + 1) * y[j] + (t ** 3 - 2 * t ** 2 + t) * hh * s[j] + (3 * t ** 2 - 2 * t ** 3) * y[j + 1] + (t ** 3 - t ** 2) * hh * s[j + 1]
    dv = (6 * t ** 2 - 6 * t) * (y[j] - y[j + 1]) / hh + (3 * t ** 2 - 4 * t + 1) * s[j] + (3 * t ** 2 - 2 * t) * s[j + 1]
    return v, dv


def smooth_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, derivative) at q of the smoothing curve; fewer than eight points are interpolated."""
    if len(x) < 8:
        return monotone(x, y, q)
    f = smooth_values(x, y, w / w.mean())
    return evaluate(x, f, second_derivatives(np.diff(x), f), q)
