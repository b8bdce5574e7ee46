"""Forecasts and the prices they wait for, joined while both arrive.

Both sides are streams with a watermark on the time they are joined by. Spark keeps the rows of each side that may still
meet one of the other, and forgets a row once the watermarks of both have passed its time: the state holds
the forecasts that are waiting and the bars of the delay, not the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import scalars as S
from pricetide.operators.evaluate import with_errors
from pricetide.streaming.ingest import WATERMARK


def _prices(bars: DataFrame, watermark: str) -> DataFrame:
    """symbol, target, price_real of a stream of bars, one per symbol and minute."""
    prices = bars.select("symbol", F.col("minute").alias("target"), F.col("price").alias("price_real"))
    return prices.withWatermark("target", watermark)


def score_stream(preds: DataFrame, bars: DataFrame, watermark: str = WATERMARK, anchor: str = "baseline") -> DataFrame:
    """Every forecast whose price has arrived, with its errors, as soon as both are there.

    ``preds`` has symbol, target and what ``evaluate.with_errors`` reads; one row a key on each side. A side later than
    the watermark finds its partner gone and is left to the batch (``evaluate.evaluated``).
    """
    waiting = preds.withWatermark("target", watermark)
    return with_errors(waiting.join(_prices(bars, watermark), ["symbol", "target"]), anchor)


def settled_stream(preds: DataFrame, bars: DataFrame, watermark: str = WATERMARK, anchor: str = "baseline") -> DataFrame:
    """Every forecast once: with its errors when the price arrives, or with none once the watermark says that it won't.

    A row without a symbol joins nothing and moves the watermark on: at the end of a replay one such row on each
    side lets out what is still waiting.
    """
    waiting = preds.withWatermark("target", watermark)
    return with_errors(waiting.join(_prices(bars, watermark), ["symbol", "target"], "left"), anchor)


def label_stream(bars: DataFrame, horizon: str = "30 minutes", limit: float = 0.15, watermark: str = WATERMARK) -> DataFrame:
    """Each bar's clipped return to the bar exactly ``horizon`` later, when that one arrives.

    The stream is joined with itself: the older side waits at the time of its label, so it is kept for the horizon
    and the delay. A bar whose counterpart is missing gives nothing.
    """
    older = bars.select(
        "symbol", (F.col("minute") + F.expr(f"interval {horizon}")).alias("label_at"), "minute", F.col("price").alias("price_then")
    ).withWatermark("label_at", watermark)
    later = bars.select("symbol", F.col("minute").alias("label_at"), F.col("price").alias("price_now")).withWatermark("label_at", watermark)
    both = older.join(later, ["symbol", "label_at"]).select("symbol", "minute", "price_then", "label_at", "price_now")
    return both.withColumn("y_label", S.bounded_change("price_now", "price_then", limit))
