"""Ticks to bars: one row per symbol and time unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, unit: str = "minute", seq: str = "seq") -> DataFrame:
    """Last price (by time, then ``seq``), total volume and number of ticks per unit.

    Partial aggregation runs before the shuffle, so a busy symbol costs one row per unit and task.
    """
    newest = F.struct("ts", seq)
    return ticks.groupBy("symbol", F.date_trunc(unit, "ts").alias("minute")).agg(
        F.max_by("price", newest).alias("price"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("n"),
    )


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` newest rows overall: a top-k, no global sort. Equal times are ordered by the other columns."""
    return df.orderBy(F.desc(order), *[c for c in df.columns if c != order]).limit(n)
