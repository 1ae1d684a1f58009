"""A small ridge logistic regression for calibrating scores on a bounded sample."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, float]:
    """(weights, intercept) by Newton's method. Rows are weighted so that label 1 has the share `prior`."""
    n1 = max(float(y.sum()), 1.0)
    n0 = max(float(len(y) - y.sum()), 1.0)
    w = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    z = np.column_stack([x, np.ones(len(y))])
    beta = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (w * (y - p)) - penalty @ beta
        curvature = (z * (w * p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(curvature, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
