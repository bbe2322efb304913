"""Logistic regression on bounded samples: plain numpy, accelerated gradient steps."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_sparse(columns: np.ndarray, starts: np.ndarray, y: np.ndarray, width: int, l2: float, ties: list[tuple[int, int, float]], rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept for rows of 0/1 features.

    `columns` holds the features of all rows, `starts` where each row begins. Minimises the mean log loss plus
    l2/2 |w|^2 plus, for each (a, b, strength) of `ties`, strength/2 (w[a] - w[b])^2; b = -1 stands for a weight of zero.
    """
    n = len(y)
    row = np.repeat(np.arange(n), np.diff(starts, append=len(columns)))
    w, b = np.zeros(width), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    # a bound of the curvature of each weight: its share of rows times the mean row size, a quarter of it
    size = len(columns) / max(1, n)
    bound = 0.25 * np.bincount(columns, minlength=width) / max(1, n) * max(1.0, size) + l2
    for i, j, strength in ties:
        bound[[i, j] if j >= 0 else [i]] += 2 * strength
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = (sigmoid(np.bincount(row, v[columns], n) + c) - y) / max(1, n)
        slope = np.bincount(columns, error[row], width) + l2 * v
        for i, j, strength in ties:
            pull = strength * (v[i] - (v[j] if j >= 0 else 0.0))
            slope[i] += pull
            if j >= 0:
                slope[j] -= pull
        new, new_b = v - slope / bound, c - error.sum() / (0.25 * max(1.0, size))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 50) -> np.ndarray:
    """Newton's method; the last column should be constant and is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + np.diag(penalty), x.T @ (p - y) / len(y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w
