"""Logistic regression on small dense tables."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """Intercept and coefficients, by Newton steps; ridge: penalty on coefficients of standardised columns."""
    weight = np.ones(len(y)) if weight is None else weight
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight))
    scale[scale < 1e-9] = 1.0
    z = np.c_[np.ones(len(y)), (x - mean) / scale]
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = sigmoid(z @ beta)
        slope = z.T @ (weight * (y - p)) - penalty * beta
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-7:
            break
    out = beta.copy()
    out[1:] = beta[1:] / scale
    out[0] -= (out[1:] * mean).sum()
    return out
