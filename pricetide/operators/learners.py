"""Online linear members: one update rule each, behind a running standardisation of the inputs.

These are the only row-by-row parts of the engine. A member's state is a few vectors as long as the
feature list; Spark hands each one the ordered rows of one group (a symbol, or a symbol, setting and
fold), whose number the row limit bounds.

Rules: stochastic gradient steps with L2 shrinkage and the step size 1/(alpha*(t0+t)) (Bottou), on
Huber's loss (1964) or the squared loss; the passive-aggressive step with a cap (Crammer et al.
2006); running mean and variance (Welford 1962, merged by blocks as in Chan et al. 1983).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np

GRADIENT_LIMIT = 1e12
# Default settings of the three members and of the tolerance of the third.
DEFAULTS = {
    "sgd": {"epsilon": 1e-3, "alpha": 5e-5},
    "ridge": {"alpha": 1e-4},
    "pa": {"C": 0.5},
}
PA_TOLERANCE = 0.1

Update = Callable[[np.ndarray, int, np.ndarray, float], np.ndarray]


def gradient_member(alpha: float, gradient: Callable[[float], float]) -> Update:
    """A gradient rule; ``w`` holds the weights and, last, the intercept, which is not shrunk."""
    first = 1.0 / (alpha * math.sqrt(1.0 / math.sqrt(alpha)))

    def update(w: np.ndarray, t: int, x: np.ndarray, y: float) -> np.ndarray:
        rate = 1.0 / (alpha * (first + t))
        residual = float(w[:-1] @ x + w[-1]) - y
        pull = min(max(gradient(residual), -GRADIENT_LIMIT), GRADIENT_LIMIT)
        w[:-1] *= max(0.0, 1.0 - rate * alpha)
        w[:-1] -= rate * pull * x
        w[-1] -= rate * pull
        return w

    return update


def huber_member(epsilon: float, alpha: float) -> Update:
    return gradient_member(alpha, lambda r: min(max(r, -epsilon), epsilon))


def squared_member(alpha: float) -> Update:
    return gradient_member(alpha, lambda r: r)


def passive_aggressive_member(C: float, tolerance: float = PA_TOLERANCE) -> Update:
    def update(w: np.ndarray, t: int, x: np.ndarray, y: float) -> np.ndarray:
        miss = y - float(w[:-1] @ x + w[-1])
        size = float(x @ x)
        excess = abs(miss) - tolerance
        if excess > 0.0 and size > 0.0:
            step = math.copysign(min(C, excess / size), miss)
            w[:-1] += step * x
            w[-1] += step
        return w

    return update


# Further members can be registered here under the name their settings carry.
MEMBER_RULES: dict[str, Callable[..., Update]] = {
    "sgd": huber_member,
    "ridge": squared_member,
    "pa": passive_aggressive_member,
}


def finite(x) -> np.ndarray:
    """Inputs as numbers: what is no finite number becomes 0."""
    values = np.asarray(x, dtype=float)
    return np.where(np.isfinite(values), values, 0.0)


class Learner:
    """One member with its scaler. Inputs must be ``finite``."""

    def __init__(self, name: str, settings: Mapping[str, float], size: int):
        self.rule = MEMBER_RULES[name](**settings)
        self.w = np.zeros(size + 1)
        self.steps = 0
        self.seen = 0.0
        self.mean = np.zeros(size)
        self.spread = np.zeros(size)

    def _observe(self, block: np.ndarray) -> None:
        n = len(block)
        mean = block.mean(axis=0)
        gap = mean - self.mean
        total = self.seen + n
        self.spread += ((block - mean) ** 2).sum(axis=0) + gap * gap * (self.seen * n / total)
        self.mean = self.mean + gap * (n / total)
        self.seen = total

    def _observe_one(self, x: np.ndarray) -> None:
        self.seen += 1.0
        gap = x - self.mean
        self.mean = self.mean + gap / self.seen
        self.spread += gap * (x - self.mean)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        deviation = np.sqrt(self.spread / max(self.seen, 1.0))
        deviation[deviation == 0.0] = 1.0
        return (x - self.mean) / deviation

    def fit(self, block: np.ndarray, targets: np.ndarray) -> None:
        """Learn a block: the scaler sees all of it, then the rule its rows in time order."""
        if not len(block):
            return
        self._observe(block)
        for x, y in zip(self._scaled(block), targets):
            self.w = self.rule(self.w, self.steps, x, float(y))
            self.steps += 1

    def update(self, x: np.ndarray, y: float) -> None:
        self._observe_one(x)
        self.w = self.rule(self.w, self.steps, self._scaled(x), y)
        self.steps += 1

    def predict(self, x: np.ndarray) -> float:
        return float(self.w[:-1] @ self._scaled(x) + self.w[-1])

    def dump(self) -> list:
        return [self.steps, self.seen, self.w.tolist(), self.mean.tolist(), self.spread.tolist()]

    def load(self, state: list) -> None:
        self.steps, self.seen = int(state[0]), float(state[1])
        self.w, self.mean, self.spread = (np.asarray(v, dtype=float) for v in state[2:])


# Members whose steps ``Panel.learn`` can make for all lines at once.
_LINES = ("sgd", "ridge", "pa")


class Panel:
    """Members of several settings over the same rows: one scaler, one matrix of weights.

    A line of the matrix is one member of one setting, and every step moves all lines at once. Each line ends
    up as a ``Learner`` of its own would.
    """

    def __init__(self, settings: list[Mapping[str, Mapping[str, float]]], size: int):
        unknown = {m for setting in settings for m in setting} - set(_LINES)
        if unknown:
            raise ValueError(f"no matrix form for the members {sorted(unknown)}")
        self.lines = [(s, m) for s in range(len(settings)) for m in _LINES if m in settings[s]]
        value = lambda k, missing: np.array([settings[s][m].get(k, missing) for s, m in self.lines], dtype=float)
        kind = np.array([m for _, m in self.lines])
        self.passive = kind == "pa"
        self.bound = np.where(kind == "sgd", value("epsilon", np.inf), np.inf)
        alpha = np.where(self.passive, 1.0, value("alpha", 1.0))
        self.alpha, self.first = alpha, 1.0 / (alpha * np.sqrt(1.0 / np.sqrt(alpha)))
        self.most = value("C", 0.0)
        self.w = np.zeros((len(self.lines), size + 1))
        self.steps = 0
        self.seen, self.mean, self.spread = 0.0, np.zeros(size), np.zeros(size)

    def observe(self, x: np.ndarray) -> None:
        """Show the scaler a row."""
        self.seen += 1.0
        gap = x - self.mean
        self.mean = self.mean + gap / self.seen
        self.spread = self.spread + gap * (x - self.mean)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        deviation = np.sqrt(self.spread / max(self.seen, 1.0))
        deviation[deviation == 0.0] = 1.0
        return (x - self.mean) / deviation

    def predict(self, x: np.ndarray) -> np.ndarray:
        """One forecast per line."""
        return self.w[:, :-1] @ self.scaled(x) + self.w[:, -1]

    def learn(self, z: np.ndarray, y: float) -> None:
        """One step on a scaled row."""
        miss = y - (self.w[:, :-1] @ z + self.w[:, -1])
        rate = 1.0 / (self.alpha * (self.first + self.steps))
        pull = np.clip(np.clip(-miss, -self.bound, self.bound), -GRADIENT_LIMIT, GRADIENT_LIMIT)
        size = float(z @ z)
        excess = np.abs(miss) - PA_TOLERANCE
        step = np.copysign(np.minimum(self.most, excess / size), miss) * (excess > 0.0) if size > 0.0 else np.zeros(len(miss))
        move = np.where(self.passive, step, -rate * pull)
        self.w[:, :-1] *= np.where(self.passive, 1.0, np.maximum(0.0, 1.0 - rate * self.alpha))[:, None]
        self.w[:, :-1] += move[:, None] * z
        self.w[:, -1] += move
        self.steps += 1

    def update(self, x: np.ndarray, y: float) -> None:
        self.observe(x)
        self.learn(self.scaled(x), y)
