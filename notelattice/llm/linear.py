"""Logistic regression over hashed sparse features, in numpy: fitting, calibration and scoring."""

from __future__ import annotations

import bisect

import numpy as np


BLOCK = 1 << 19  # stored values handled at once, so that working arrays stay small beside the data


def fit(index: np.ndarray, value: np.ndarray, off: np.ndarray, target: np.ndarray, size: int, l2: float = 1e-4, steps: int = 150, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean log loss plus l2, by full-batch Adam. target: labels, or probabilities.

    Row i has the values off[i] to off[i + 1]; off may begin anywhere in index and value, which are only read.
    """
    cuts = [0]
    while cuts[-1] < len(target):
        cuts.append(min(len(target), max(cuts[-1] + 1, int(np.searchsorted(off, off[cuts[-1]] + BLOCK, side="right")) - 1)))
    weight, bias = np.zeros(size), 0.0
    m, v, grad = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        grad[:size], grad[size] = l2 * weight, 0.0
        for a, b in zip(cuts, cuts[1:], strict=False):
            i, x, n = index[off[a] : off[b]], value[off[a] : off[b]], np.diff(off[a : b + 1])
            row = np.repeat(np.arange(b - a), n)
            margin = np.bincount(row, weights=weight[i] * x, minlength=b - a) + bias
            error = (sigmoid(margin) - target[a:b]) / max(1, len(target))
            grad[:size] += np.bincount(i, weights=error[row] * x, minlength=size)
            grad[size] += error.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        weight -= move[:size]
        bias -= move[size]
    return weight, float(bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def calibrate(margin: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of Platt's sigmoid on rows that the weights were not fitted on, with his smoothed targets."""
    good, bad = float((label > 0.5).sum()), float((label <= 0.5).sum())
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(label > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(1e-9, float(np.std(margin)))
    x, a, b = margin / scale, 1.0, 0.0
    for _ in range(steps):  # Newton with a small ridge
        p = sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3) / scale), float(b)


class Bounded:
    """The rows with the lowest keys, as many as have `most` values together; whatever the order of arrival, the same ones."""

    def __init__(self, most: int):
        self.most, self.total, self.rows, self.end = most, 0, [], None

    def add(self, key: tuple, row: tuple, n: int) -> None:
        if self.end is not None and key >= self.end:
            return
        bisect.insort(self.rows, (key, n, row))
        self.total += n
        while self.total > self.most and len(self.rows) > 1:
            self.end, out, _ = self.rows.pop()
            self.total -= out
