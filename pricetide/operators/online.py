"""The forecasting loop of one symbol: learn from labels as they arrive, forecast, weigh members.

``ForecastLoop.step`` takes one row at a time; the batch replay and the stream call the same step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np

from pricetide.operators.learners import DEFAULTS, Learner, finite

MINUTE = 60


@dataclass(frozen=True)
class LoopSpec:
    """How one horizon runs.

    ``label_by_time`` takes the label from the bar exactly one horizon later, else from the next
    row. ``feature_lag=1`` forecasts from the features of the row before.
    """

    horizon_min: int = 1
    label_by_time: bool = False
    ret_clip: float = 0.05
    clip_members: bool = True
    eps: float = 1e-6
    seed_error: float = 0.01
    error_alpha: float = 0.2
    weights_after_update: bool = False
    feature_lag: int = 0
    min_history: int = 1200
    max_rows: int = 8000
    init_rows: int = 600
    bar_seconds: int = MINUTE


def check_block(spec: LoopSpec) -> None:
    """The first rows are learnt at once with labels that lie up to a horizon ahead, so no forecast may be made before those."""
    if spec.init_rows and spec.min_history < spec.init_rows + spec.horizon_min:
        raise ValueError("min_history must be at least init_rows + horizon_min: forecasts would know their own labels")


# The settings of the two horizons.
ONE_MINUTE_LOOP = LoopSpec()
THIRTY_MINUTE_LOOP = LoopSpec(
    horizon_min=30,
    label_by_time=True,
    ret_clip=0.15,
    clip_members=False,
    eps=1e-8,
    seed_error=0.02,
    weights_after_update=True,
    min_history=2000,
    max_rows=12000,
    init_rows=800,
)


class ForecastLoop:
    def __init__(self, spec: LoopSpec, size: int, settings: Mapping[str, Mapping[str, float]] = DEFAULTS):
        self.spec = spec
        self.members = {m: Learner(m, s, size) for m, s in settings.items()}
        self.error = {m: spec.seed_error for m in self.members}
        self.waiting: dict[int, tuple[float, np.ndarray]] = {}
        self.open: dict[int, dict[str, float]] = {}
        self.last: tuple[float, np.ndarray] | None = None
        self.last_minute = -1
        self.rows = 0

    def weights(self) -> dict[str, float]:
        inverse = {m: 1.0 / (e + self.spec.eps) for m, e in self.error.items()}
        total = sum(inverse.values())
        return {m: v / total for m, v in inverse.items()}

    def _clipped(self, r: float) -> float:
        return min(max(r, -self.spec.ret_clip), self.spec.ret_clip)

    def _learn(self, old: tuple[float, np.ndarray] | None, price: float) -> bool:
        if old is None or not old[0]:
            return False
        label = self._clipped(price / old[0] - 1.0)
        for member in self.members.values():
            member.update(old[1], label)
        return True

    def _score(self, minute: int, price: float) -> float | None:
        """Fold the errors of the forecasts made for this minute into the averages."""
        made = self.open.pop(minute, None)
        if made is None:
            return None
        a = self.spec.error_alpha
        for m in self.members:
            self.error[m] = a * abs(price - made[m]) + (1.0 - a) * self.error[m]
        return abs(price - made["y_hat"])

    def learn_block(self, minutes: Sequence[int], prices: Sequence[float], x: np.ndarray, labels) -> None:
        """Fit the first rows of a history at once; ``labels`` may hold NaN where there is none."""
        known = ~np.isnan(np.asarray(labels, dtype=float))
        for member in self.members.values():
            member.fit(finite(x)[known], np.asarray(labels, dtype=float)[known])
        self.rows += len(x)

    def step(self, minute: int, price: float, x: Sequence[float]) -> dict | None:
        """Take the bar of ``minute`` (epoch seconds) and its features; return the new forecast."""
        spec = self.spec
        if minute <= self.last_minute:
            return None
        horizon = spec.horizon_min * spec.bar_seconds
        x = finite(x)
        before = self.last
        if spec.label_by_time:
            learned = self._learn(self.waiting.pop(minute - horizon, None), price)
            self.waiting = {m: v for m, v in self.waiting.items() if m > minute - horizon}
            self.waiting[minute] = (price, x)
        else:
            learned = self._learn(before, price)
        self.last, self.last_minute = (price, x), minute
        self.rows += 1

        weights = self.weights()
        scored = None
        if learned or not spec.label_by_time:
            scored = self._score(minute, price)
        if spec.weights_after_update:
            weights = self.weights()
        self.open = {m: v for m, v in self.open.items() if m > minute}
        if self.rows < spec.min_history:
            return None

        inputs = before[1] if spec.feature_lag and before is not None else x
        moves = {m: self._clipped(member.predict(inputs)) for m, member in self.members.items()}
        move = sum(weights[m] * moves[m] for m in moves)
        lo, hi = price * (1.0 - spec.ret_clip), price * (1.0 + spec.ret_clip)
        prices = {m: price * (1.0 + r) for m, r in moves.items()}
        if spec.clip_members:
            prices = {m: min(max(p, lo), hi) for m, p in prices.items()}
        forecast = {
            "target": minute + horizon,
            "y_hat": min(max(price * (1.0 + move), lo), hi),
            "y_hat_ret": move,
            "baseline": price,
            "mae": scored,
            **{f"y_hat_{m}": prices[m] for m in prices},
            **{f"w_{m}": weights[m] for m in weights},
        }
        self.open[forecast["target"]] = {**prices, "y_hat": forecast["y_hat"]}
        return forecast

    def dump(self) -> dict:
        return {
            "members": {m: member.dump() for m, member in self.members.items()},
            "error": self.error,
            "waiting": [[m, p, x.tolist()] for m, (p, x) in self.waiting.items()],
            "open": [[m, v] for m, v in self.open.items()],
            "last": [self.last[0], self.last[1].tolist()] if self.last else None,
            "last_minute": self.last_minute,
            "rows": self.rows,
        }

    def load(self, state: dict) -> "ForecastLoop":
        for m, member in self.members.items():
            member.load(state["members"][m])
        self.error = dict(state["error"])
        self.waiting = {m: (p, np.asarray(x)) for m, p, x in state["waiting"]}
        self.open = {m: v for m, v in state["open"]}
        last = state["last"]
        self.last = (last[0], np.asarray(last[1])) if last else None
        self.last_minute, self.rows = state["last_minute"], state["rows"]
        return self
