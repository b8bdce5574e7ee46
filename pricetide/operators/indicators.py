"""Technical indicators as column expressions over a chunked series (see ``series``).

The functions take the layout of the chunked frame and return columns; they hold inside one run, so
a frame must carry at least ``look_back(...)`` copied rows in front of each run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import scalars as S
from pricetide.operators.series import Ema, Layout, ema, halo_rows, span_alpha

# The indicator settings every result depends on.
RETURN_LAGS = (1, 2, 3, 4, 5, 10, 15, 30, 60)
EMA_SPANS = (5, 10, 20, 30)
STD_WINDOWS = (5, 10, 20, 30)
MACD_SPANS = (12, 26, 9)
RSI_WINDOW = 14
BOLLINGER = (20, 2.0)
GAP_CLIP = 0.2
SLOPE_CLIP = 0.1
OBV_CLIP = 0.5


def look_back(alphas: Sequence[float], rows: int, layout: Layout) -> int:
    """Copied rows needed for these averages and this longest row look-back."""
    return max(halo_rows(alphas, layout.sub_rows), rows)


def lag(layout: Layout, x: Column | str, n: int = 1) -> Column:
    return F.lag(x, n).over(layout.rows())


def lead(layout: Layout, x: Column | str, n: int = 1) -> Column:
    return F.lead(x, n).over(layout.rows())


def with_rolling(df: DataFrame, layout: Layout, specs: Mapping[str, tuple[str, str, int]]) -> DataFrame:
    """Add rolling statistics: name -> (``mean`` | ``std`` | ``std_pop``, column, rows).

    NULL until the window holds that many values. The frames are evaluated once, as columns.
    """
    kinds = {"mean": F.avg, "std": F.stddev_samp, "std_pop": F.stddev_pop}
    raw, out = {}, {}
    for name, (kind, x, n) in specs.items():
        raw[f"_v_{name}"] = kinds[kind](x).over(layout.last(n))
        raw[f"_n_{x}_{n}"] = F.count(x).over(layout.last(n))
        out[name] = F.when(F.col(f"_n_{x}_{n}") == n, F.col(f"_v_{name}"))
    return df.withColumns(raw).withColumns(out).drop(*raw)


class Spread:
    """Mean and squared deviation of the last 5, 10, 20, ... rows of a column without NULLs.

    A window of n rows is the merge of two windows of n/2 rows, one of them n/2 rows back (Chan et
    al. 1983), so only the shortest is summed row by row. ``frames`` are the columns for the first
    window pass and ``halves(n)`` those for the next one, each followed by ``merged``.
    """

    def __init__(self, layout: Layout, column: str, base: int = 5):
        self.layout, self.column, self.base = layout, column, base

    def names(self, n: int) -> tuple[str, str]:
        return f"_mean{n}_{self.column}", f"_dev{n}_{self.column}"

    def frames(self) -> dict[str, Column]:
        window = self.layout.last(self.base)
        mean, dev = self.names(self.base)
        return {mean: F.avg(self.column).over(window), dev: F.var_pop(self.column).over(window) * self.base}

    def back(self, n: int, rows: int) -> dict[str, Column]:
        """The statistics of ``n`` rows as they were ``rows`` rows ago."""
        return {f"{c}_{rows}": F.lag(c, rows).over(self.layout.rows()) for c in self.names(n)}

    def merged(self, n: int, m: int) -> dict[str, Column]:
        """The last ``n + m`` rows from the last ``n`` and the ``m`` before, which ``back(m, n)`` gave."""
        mean, dev = (F.col(c) for c in self.names(n))
        mean0, dev0 = (F.col(f"{c}_{n}") for c in self.names(m))
        gap = mean - mean0
        out_mean, out_dev = self.names(n + m)
        return {
            out_mean: (mean * n + mean0 * m) / (n + m),
            out_dev: dev + dev0 + gap * gap * (n * m / (n + m)),
        }

    def std(self, n: int) -> Column:
        """Sample deviation of the last ``n`` rows, NULL until the series has that many."""
        return F.when(F.col("gi") >= n - 1, F.sqrt(F.col(self.names(n)[1]) / (n - 1)))

    def mean(self, n: int) -> Column:
        return F.when(F.col("gi") >= n - 1, F.col(self.names(n)[0]))


def bounded_return(price: Column | str, prev: Column | str, limit: float) -> Column:
    """Clipped relative change, 0 where there is none."""
    return F.coalesce(S.bounded_change(price, prev, limit), F.lit(0.0))


def with_rsi(df: DataFrame, layout: Layout, price: str, eps: float, window: int = RSI_WINDOW) -> DataFrame:
    """Add ``rsi``: averages of gains and losses start at the second row; NULL on the first."""
    moved = with_gain_loss(df, layout, price)
    scanned = ema(moved, layout, rsi_scans(window))
    return scanned.withColumn("rsi", rsi_value("up", "down", eps)).drop("gain", "loss", "up", "down")


def with_gain_loss(df: DataFrame, layout: Layout, price: str) -> DataFrame:
    """Add ``gain`` and ``loss`` of each move, NULL on the first row of the series."""
    moved = df.withColumn("_prev", lag(layout, price))
    return gain_loss_from(moved, price, "_prev").drop("_prev")


def gain_loss_from(df: DataFrame, price: str, prev: str) -> DataFrame:
    delta = F.col(price) - F.col(prev)
    up = F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))
    down = F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))
    return df.withColumns({"gain": up, "loss": down})


def rsi_scans(window: int = RSI_WINDOW) -> dict[str, Ema]:
    return {"up": Ema("gain", 1.0 / window, first=1), "down": Ema("loss", 1.0 / window, first=1)}


def rsi_value(up: str, down: str, eps: float) -> Column:
    strength = F.col(up) / (F.col(down) + eps)
    return 100.0 - 100.0 / (1.0 + strength)


def with_macd(
    df: DataFrame, layout: Layout, price: str, spans: tuple[int, int, int] = MACD_SPANS
) -> DataFrame:
    """Add ``macd``, ``macd_signal``, ``macd_hist``."""
    fast, slow, signal = spans
    scans = {"_fast": Ema(price, span_alpha(fast)), "_slow": Ema(price, span_alpha(slow))}
    return macd_from(ema(df, layout, scans), layout, "_fast", "_slow", signal).drop("_fast", "_slow")


def macd_from(
    df: DataFrame,
    layout: Layout,
    fast: str,
    slow: str,
    signal: int,
    alongside: Mapping[str, Column] | None = None,
) -> DataFrame:
    line = df.withColumn("macd", F.col(fast) - F.col(slow))
    smooth = ema(line, layout, {"macd_signal": Ema("macd", span_alpha(signal))}, alongside)
    return smooth.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def bollinger_width(mid: str, sd: str, eps: float) -> Column:
    """Width of the band of sample deviations over its middle, 0 until the window is full."""
    k = BOLLINGER[1]
    upper, lower = F.col(mid) + k * F.col(sd), F.col(mid) - k * F.col(sd)
    return F.coalesce((upper - lower) / (F.col(mid) + eps), F.lit(0.0))


def signed_volume(price: str, prev: str, volume: str) -> Column:
    """Volume with the sign of the price move; 0 on the first row and for a missing volume."""
    return F.coalesce(F.signum(F.col(price) - F.col(prev)) * F.col(volume), F.lit(0.0))
