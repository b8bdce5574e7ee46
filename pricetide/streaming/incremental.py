"""The feature row of the newest bar from a bounded state, for the stream.

The batch plan (``plans.features``) defines the features; this keeps just enough of a symbol's past
to continue them: the last returns and prices, the running averages, volume and balance.
"""

from __future__ import annotations

import math

import numpy as np

from pricetide.functions.scalars import MINUTES_PER_DAY
from pricetide.operators import indicators as I
from pricetide.operators.series import span_alpha
from pricetide.plans.features import FEATURES, FeatureSpec

NAN = float("nan")
KEPT_RETURNS = max(I.RETURN_LAGS) + 1


def _ratio(cur: float, prev: float, limit: float) -> float:
    if math.isnan(cur) or math.isnan(prev) or (prev == 0 and cur == 0):
        return NAN
    move = math.copysign(math.inf, cur) if prev == 0 else cur / prev - 1.0
    return min(max(move, -limit), limit)


def _ratio_or_zero(cur: float, prev: float) -> float:
    return 0.0 if math.isnan(cur) or math.isnan(prev) or prev == 0 else cur / prev - 1.0


class FeatureState:
    def __init__(self, spec: FeatureSpec):
        self.spec = spec
        self.returns: list[float] = []
        self.prices: list[float] = []
        self.average: dict[str, float] = {}
        self.volume, self.balance = NAN, 0.0

    def _smooth(self, name: str, x: float, alpha: float) -> tuple[float, float]:
        """Advance one average; returns its old (NaN if none) and new value."""
        old = self.average.get(name, NAN)
        new = x if math.isnan(old) else alpha * x + (1.0 - alpha) * old
        self.average[name] = new
        return old, new

    def push(self, ts: float, price: float, open_: float, volume: float, return_pct: float) -> list[float]:
        spec, f = self.spec, {}
        prev = self.prices[-1] if self.prices else NAN
        ret = _ratio(price, prev, spec.ret_clip)
        ret = 0.0 if math.isnan(ret) else ret
        self.returns = [*self.returns, ret][-KEPT_RETURNS:]
        self.prices = [*self.prices, price][-I.BOLLINGER[0] :]
        f.update(price=price, open=open_, volume=volume, return_pct=return_pct, ret=ret)

        was, self.volume = self.volume, self.volume if math.isnan(volume) else volume
        f["vol_chg"] = _ratio_or_zero(self.volume, was)
        f["log_vol"] = 0.0 if volume == -1.0 else math.log1p(volume) if volume > -1.0 else NAN
        for n in I.RETURN_LAGS:
            f[f"ret_lag_{n}"] = self.returns[-1 - n] if len(self.returns) > n else NAN
        for n in I.EMA_SPANS:
            old, new = self._smooth(f"ema{n}", price, span_alpha(n))
            f[f"ema_gap_{n}"] = _ratio(price, new, I.GAP_CLIP)
            f[f"ema_slope_{n}"] = _ratio(new, old, I.SLOPE_CLIP)
        for n in I.STD_WINDOWS:
            last = self.returns[-n:]
            full = len(last) == n
            f[f"rstd_{n}"] = min(max(float(np.std(last, ddof=1)), 0.0), spec.std_clip) if full else NAN

        f["rsi_14"] = 50.0
        if not math.isnan(prev):
            _, up = self._smooth("up", max(price - prev, 0.0), 1.0 / I.RSI_WINDOW)
            _, down = self._smooth("down", max(prev - price, 0.0), 1.0 / I.RSI_WINDOW)
            f["rsi_14"] = 100.0 - 100.0 / (1.0 + up / (down + spec.eps))
        fast, slow, signal = I.MACD_SPANS
        line = self._smooth("fast", price, span_alpha(fast))[1] - self._smooth("slow", price, span_alpha(slow))[1]
        smooth = self._smooth("signal", line, span_alpha(signal))[1]
        f.update(macd=line, macd_signal=smooth, macd_hist=line - smooth)

        f["bb_width"] = 0.0
        if len(self.prices) == I.BOLLINGER[0]:
            band = 2.0 * I.BOLLINGER[1] * float(np.std(self.prices, ddof=1))
            f["bb_width"] = band / (float(np.mean(self.prices)) + spec.eps)
        moved = 0.0 if math.isnan(prev) else float(np.sign(price - prev))
        before = self.balance
        self.balance += 0.0 if math.isnan(volume) else moved * volume
        f["obv"] = self.balance
        f["obv_chg"] = min(max(_ratio_or_zero(self.balance, before), -I.OBV_CLIP), I.OBV_CLIP)
        angle = (int(ts) // 60 % MINUTES_PER_DAY) * (2.0 * math.pi / MINUTES_PER_DAY)
        f.update(sin_m=math.sin(angle), cos_m=math.cos(angle))
        return [f[name] for name in FEATURES]

    def dump(self) -> dict:
        return {
            "returns": self.returns,
            "prices": self.prices,
            "average": self.average,
            "volume": self.volume,
            "balance": self.balance,
        }

    def load(self, state: dict) -> "FeatureState":
        for name, value in state.items():
            setattr(self, name, value)
        return self
