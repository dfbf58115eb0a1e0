"""Distributions and model fits that the engine has no function for."""

from __future__ import annotations

import math

import numpy as np

#: The normal quantile of a two-sided 95 % interval.
Z975 = 1.959963984540054


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz' evaluation of the incomplete beta's continued fraction."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_p(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """(estimate, standard error) of the second column of x, by reweighted least squares; None where no finite one exists."""
    w = np.zeros(x.shape[1])
    last = np.inf
    for _ in range(25):
        eta = x @ w
        p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-12)
        h = x.T @ (x * v[:, None])
        if np.linalg.matrix_rank(h, tol=1e-9 * np.abs(h).max()) < len(w):
            return None
        w = np.linalg.solve(h, x.T @ (v * eta + y - p))
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        deviance = -2 * np.sum(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-300, 1)))
        if abs(deviance - last) < 1e-10 * (abs(deviance) + 0.1):
            break
        last = deviance
    v = p * (1 - p)
    if deviance < 1e-6 or v.max() < 1e-8:
        return None
    cov = np.linalg.inv(x.T @ (x * v[:, None]))
    return float(w[1]), float(math.sqrt(cov[1, 1]))


def linear_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """(estimate, standard error) of the second column of x, by least squares; None without spare rows or rank."""
    n, k = x.shape
    if n <= k or np.linalg.matrix_rank(x) < k:
        return None
    inverse = np.linalg.inv(x.T @ x)
    w = inverse @ (x.T @ y)
    spread = float(((y - x @ w) ** 2).sum()) / (n - k)
    return float(w[1]), float(math.sqrt(spread * inverse[1, 1]))
