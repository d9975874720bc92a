"""Losses of models that are trained by gradients: NumPy functions of targets, raw scores and weights, run inside tasks.

A raw score is what trees or weights add up; link turns it into a prediction. With k classes raw scores have a column for
each class.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Loss:
    """grad(y, s) gives gradient and curvature for each row (and class), value(y, s) the loss of each row, both unweighted.

    quantile: a leaf's value is this quantile of its residuals (losses whose gradient tells no distance), else a Newton step.
    forward turns targets into what is fitted. start: mean, logit, quantile or prior, the raw score before any tree.
    """

    name: str
    grad: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    value: Callable[[np.ndarray, np.ndarray], np.ndarray]
    link: Callable[[np.ndarray], np.ndarray] = lambda s: s
    forward: Callable[[np.ndarray], np.ndarray] = lambda y: y
    weight: Callable[[np.ndarray], np.ndarray] | None = None
    quantile: float | None = None
    start: str = "mean"
    classes: int = 1


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def mse() -> Loss:
    return Loss("mse", lambda y, s: (s - y, np.ones_like(s)), lambda y, s: (s - y) ** 2)


def rmsle() -> Loss:
    """Squared error of log(1 + y)."""
    return Loss("rmsle", lambda y, s: (s - y, np.ones_like(s)), lambda y, s: (s - y) ** 2, np.expm1, np.log1p)


def mae() -> Loss:
    return Loss("mae", lambda y, s: (np.sign(s - y), np.ones_like(s)), lambda y, s: np.abs(s - y), quantile=0.5, start="quantile")


def mape() -> Loss:
    """Absolute error in parts of |y|, of targets below 1 in parts of 1."""
    w = lambda y: 1 / np.maximum(1.0, np.abs(y))
    return Loss("mape", lambda y, s: (np.sign(s - y), np.ones_like(s)), lambda y, s: np.abs(s - y), weight=w, quantile=0.5, start="quantile")


def quantile(q: float = 0.9) -> Loss:
    """Targets above the prediction weigh q, below 1 - q."""
    return Loss("quantile", lambda y, s: (np.where(s >= y, 1 - q, -q), np.ones_like(s)), lambda y, s: np.where(s >= y, (1 - q) * (s - y), q * (y - s)), quantile=q, start="quantile")


def huber(a: float = 0.9) -> Loss:
    return Loss("huber", lambda y, s: (np.clip(s - y, -a, a), np.ones_like(s)), lambda y, s: np.where(np.abs(s - y) < a, (s - y) ** 2 / 2, a * np.abs(s - y) - a * a / 2))


def fair(c: float = 0.9) -> Loss:
    def grad(y, s):
        e = s - y
        return c * e / (np.abs(e) + c), c * c / (np.abs(e) + c) ** 2

    return Loss("fair", grad, lambda y, s: c * c * (np.abs(s - y) / c - np.log1p(np.abs(s - y) / c)))


def logloss() -> Loss:
    def grad(y, s):
        p = _sigmoid(s)
        return p - y, p * (1 - p)

    return Loss("logloss", grad, lambda y, s: np.logaddexp(0, s) - y * s, _sigmoid, start="logit")


def crossentropy(k: int) -> Loss:
    """y holds class numbers from 0."""

    def grad(y, s):
        p = _softmax(s)
        hit = y[..., None] == np.arange(k)
        return p - hit, p * (1 - p) * k / (k - 1)

    def value(y, s):
        top = s.max(axis=-1)
        return np.log(np.exp(s - top[..., None]).sum(axis=-1)) + top - np.take_along_axis(s, y.astype(np.int64)[..., None], -1)[..., 0]

    return Loss("crossentropy", grad, value, _softmax, start="prior", classes=k)


LOSSES: dict[str, Callable[..., Loss]] = {"mse": mse, "rmsle": rmsle, "mae": mae, "mape": mape, "quantile": quantile, "huber": huber, "fair": fair, "logloss": logloss, "crossentropy": crossentropy}
DEFAULT = {"reg": "mse", "binary": "logloss", "multiclass": "crossentropy"}


def of(task: str, loss: str | Loss | None = None, classes: int = 2, **params: float) -> Loss:
    """A loss by name (the task's own without one), or a Loss of one's own."""
    if isinstance(loss, Loss):
        return loss
    name = loss or DEFAULT[task]
    return LOSSES[name](classes) if name == "crossentropy" else LOSSES[name](**params)
