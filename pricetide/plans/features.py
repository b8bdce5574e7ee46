"""The model feature matrix: one plan of indicator operators over a price series.

Input columns: symbol, ts, seq, price, open, volume, return_pct (clean, one row per symbol and ts).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import scalars as S
from pricetide.operators import indicators as I
from pricetide.operators.series import (
    CELL,
    Ema,
    Layout,
    carry_in,
    chunk,
    dense_index,
    ema,
    filled,
    home_rows,
    running_sum,
    span_alpha,
    tail_rows,
)
from pricetide.session import stage


@dataclass(frozen=True)
class FeatureSpec:
    horizon: int = 1
    ret_clip: float = 0.05
    std_clip: float = 0.05
    target_clip: float = 0.05
    eps: float = 1e-6
    drop_null: bool = True
    target: str = "y_ret"


# The settings of the two forecast horizons.
ONE_MINUTE = FeatureSpec()
THIRTY_MINUTES = FeatureSpec(
    horizon=30, ret_clip=0.1, std_clip=0.1, target_clip=0.15, eps=1e-8, drop_null=False, target="y_ret_h"
)

RAW_INPUTS = ("price", "open", "volume", "return_pct")
FEATURES = (
    *RAW_INPUTS,
    "ret",
    "vol_chg",
    "log_vol",
    *(f"ret_lag_{n}" for n in I.RETURN_LAGS),
    *(f"ema_gap_{n}" for n in I.EMA_SPANS),
    *(f"ema_slope_{n}" for n in I.EMA_SPANS),
    *(f"rstd_{n}" for n in I.STD_WINDOWS),
    "rsi_14",
    "macd",
    "macd_signal",
    "macd_hist",
    "bb_width",
    "obv",
    "obv_chg",
    "sin_m",
    "cos_m",
)
ALPHAS = tuple(span_alpha(n) for n in (*I.EMA_SPANS, *I.MACD_SPANS)) + (1.0 / I.RSI_WINDOW,)


def feature_matrix(
    ticks: DataFrame,
    spec: FeatureSpec = ONE_MINUTE,
    layout: Layout = Layout(),
    limit: int | None = None,
    staged: bool = True,
) -> DataFrame:
    """All model inputs and the target, keyed by (symbol, ts).

    ``limit`` keeps the newest rows of each symbol first, so running values restart with them.
    ``staged`` writes the numbered rows to the shared folder once, so that the second pass for the
    running totals does not redo the reading and numbering; without it the plan stays lazy.
    """
    # The cell of clustered ticks (``sources.clustered``) saves the exchange that numbers them.
    rows = ticks.select(layout.key, *layout.order, *RAW_INPUTS, *[c for c in ticks.columns if c == CELL])
    if limit is not None:
        rows = tail_rows(rows, layout, limit)
    indexed = dense_index(rows, layout, {"_prev": "price"})
    if staged:
        indexed = stage(indexed, "indexed")
    indexed = indexed.withColumn("_signed", I.signed_volume("price", "_prev", "volume"))
    back = I.look_back(ALPHAS, max(I.RETURN_LAGS) + 1, layout)
    df, layout = chunk(indexed, layout, back=back, ahead=spec.horizon)

    df = df.withColumn("_next", I.lead(layout, "price", spec.horizon))
    totals = {"_obv_in": ("sum", F.col("_signed")), "_vol_in": ("last", F.col("volume"))}
    df = carry_in(df, layout, totals, indexed)
    # Three passes over the rows of a run follow; each carries every window that is ready by then.
    df = I.gain_loss_from(df, "price", "_prev").withColumn(
        "ret", I.bounded_return("price", "_prev", spec.ret_clip)
    )
    moves, levels = I.Spread(layout, "ret"), I.Spread(layout, "price")
    df = df.withColumns(
        {
            "_filled": filled(layout, F.col("volume"), "_vol_in"),
            "obv": running_sum(layout, F.col("_signed"), "_obv_in"),
            **moves.frames(),
            **levels.frames(),
        }
    )

    fast, slow, signal = I.MACD_SPANS
    scans = {f"_ema{n}": Ema("price", span_alpha(n)) for n in I.EMA_SPANS}
    scans |= {"_fast": Ema("price", span_alpha(fast)), "_slow": Ema("price", span_alpha(slow))}
    scans |= I.rsi_scans()
    df = ema(df, layout, scans, alongside={**moves.back(5, 5), **levels.back(5, 5)})
    df = df.withColumns({**moves.merged(5, 5), **levels.merged(5, 5)})

    lags = {f"ret_lag_{n}": I.lag(layout, "ret", n) for n in I.RETURN_LAGS}
    lags |= {f"_prev_ema{n}": I.lag(layout, f"_ema{n}") for n in I.EMA_SPANS}
    lags |= {"_prev_filled": I.lag(layout, "_filled"), "_prev_obv": I.lag(layout, "obv")}
    lags |= {**moves.back(10, 10), **moves.back(10, 20), **levels.back(10, 10)}
    df = I.macd_from(df, layout, "_fast", "_slow", signal, alongside=lags)
    df = df.withColumns({**moves.merged(10, 10), **levels.merged(10, 10)})
    df = df.withColumns(moves.merged(20, 10))
    band = I.BOLLINGER[0]
    df = df.withColumns({"_mid": levels.mean(band), "_sd": levels.std(band)})

    angle = S.day_angle(layout.order[0])
    obv_chg = F.least(S.change_or_zero("obv", "_prev_obv"), F.lit(I.OBV_CLIP))
    out = {
        "vol_chg": S.change_or_zero("_filled", "_prev_filled"),
        "log_vol": S.log1p_or_zero("volume"),
        "rsi_14": F.coalesce(I.rsi_value("up", "down", spec.eps), F.lit(50.0)),
        "bb_width": I.bollinger_width("_mid", "_sd", spec.eps),
        "obv_chg": F.greatest(obv_chg, F.lit(-I.OBV_CLIP)),
        "sin_m": F.sin(angle),
        "cos_m": F.cos(angle),
        spec.target: S.bounded_change("_next", "price", spec.target_clip),
    }
    for n in I.EMA_SPANS:
        out[f"ema_gap_{n}"] = S.bounded_change("price", f"_ema{n}", I.GAP_CLIP)
        out[f"ema_slope_{n}"] = S.bounded_change(f"_ema{n}", f"_prev_ema{n}", I.SLOPE_CLIP)
    for n in I.STD_WINDOWS:
        out[f"rstd_{n}"] = F.when(F.col("gi") >= n - 1, F.least(moves.std(n), F.lit(spec.std_clip)))
    df = df.withColumns(out)

    result = home_rows(df).select(layout.key, *layout.order, "gi", *FEATURES, spec.target)
    if spec.drop_null:
        # Raw columns count too: a row with any missing value is no training row.
        result = result.dropna("any", subset=[*FEATURES, spec.target])
    return result


def layout_for(bar_seconds: int, layout: Layout = Layout()) -> Layout:
    """A layout whose time cells hold at most 1440 bars of this length."""
    return replace(layout, cell_seconds=bar_seconds * S.MINUTES_PER_DAY)
