"""Two-state linear-chain conditional random fields over many sequences at once.

With two states all that matters is the ratio of state 1 to state 0, so forward
and backward messages are one number a position. Sequences run side by side,
longest first, one numpy step a position, so none is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights of the features, and log potentials of (start 1 against 0, 0-1, 1-0, 1-1 against 0-0)."""

    weight: np.ndarray
    link: np.ndarray


def _messages(x: np.ndarray, first: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward ratios (with the position's own evidence) and backward ratios."""
    start, a01, a10, a11 = np.exp(link)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(most), "left")
    r, b = np.empty(len(x)), np.empty(len(x))
    held = None
    for t in range(most):
        at = begin[: live[t]] + t
        held = x[at] * (start if t == 0 else (a01 + held[: live[t]] * a11) / (1 + held[: live[t]] * a10))
        np.clip(held, 1e-60, 1e60, out=held)
        r[at] = held
    for t in range(most):
        at = begin[: live[t]] + size[: live[t]] - 1 - t
        if t == 0:
            held = np.ones(len(at))
        else:
            y = x[at + 1] * held[: live[t]]
            held = (a10 + a11 * y) / (1 + a01 * y)
        b[at] = held
    return r, b


def marginals(feature: np.ndarray, first: np.ndarray, chain: Chain) -> np.ndarray:
    """Probability of state 1 at each position; sequences are rows first[i] to first[i + 1]."""
    if not len(feature):
        return np.zeros(0)
    r, b = _messages(np.exp(np.clip(feature @ chain.weight, -30, 30)), first, chain.link)
    return r * b / (1 + r * b)


def _gradient(feature: np.ndarray, state: np.ndarray, first: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Weighted counts of features and links as seen, less those hoped for under theta."""
    first = np.concatenate([[0], np.unique(first[1:])])  # sequences without positions say nothing
    n, k = feature.shape
    head = np.zeros(n, bool)
    head[first[:-1]] = True
    inner = np.flatnonzero(~head)
    y, prev = state.astype(float), state[inner - 1].astype(bool)
    here = state[inner].astype(bool)
    x = np.exp(np.clip(feature @ theta[:k], -30, 30))
    link = theta[k:]
    r, b = _messages(x, first, link)
    p = r * b / (1 + r * b)
    left, right = r[inner - 1], x[inner] * b[inner]
    p01, p10, p11 = np.exp(link[1]) * right, np.exp(link[2]) * left, np.exp(link[3]) * left * right
    z, w = 1 + p01 + p10 + p11, weight[inner]
    off = weight * (y - p)
    return np.concatenate([feature.T @ off, [off[head].sum(), w @ ((~prev & here) - p01 / z), w @ ((prev & ~here) - p10 / z), w @ ((prev & here) - p11 / z)]])


def fit_blocks(blocks: Callable[[], Iterable[tuple]], k: int, l2: float = 1e-3, rounds: int = 80, rate: float = 0.2) -> Chain:
    """Largest likelihood of the given states, by Adam over all sequences.

    blocks() gives (feature, state, first, positions' weights) of some whole sequences after others,
    anew each round, so that only one block is held. k: columns of a feature.
    """
    theta, m, v = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    for step in range(1, rounds + 1):
        n, total = 0.0, np.zeros(k + 4)
        for feature, state, first, weight in blocks():
            n, total = n + weight.sum(), total + _gradient(feature, state, first, weight, theta)
        grad = total / (n or 1) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - 0.8 * step / rounds)
        theta[k:] = np.clip(theta[k:], -8, 8)
    return Chain(theta[:k], theta[k:])


def fit(feature: np.ndarray, state: np.ndarray, first: np.ndarray, l2: float = 1e-3, rounds: int = 80, rate: float = 0.2) -> Chain:
    """fit_blocks of one block, all positions alike."""
    return fit_blocks(lambda: [(feature, state, first, np.ones(len(feature)))], feature.shape[1], l2, rounds, rate)


def logistic(feature: np.ndarray, label: np.ndarray, l2: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method."""
    x = np.column_stack([feature, np.ones(len(feature))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (label - p) / len(x) - l2 * w)
    return w


def sigmoid(feature: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(feature @ w[:-1] + w[-1], -30, 30)))
