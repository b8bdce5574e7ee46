"""Bars of a stream whose late rows are kept aside, and the rebuild of just the bars that they touch.

The watermark says when a bar is closed: it is written once and its state is dropped. A tick that comes after
that would be lost inside Spark's own window aggregation. Here each (symbol, bar) is a keyed state with a timer
at the bar's end, and a tick whose bar is behind the watermark leaves as a late row instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricetide.sources.readers import read_if_exists
from pricetide.sources.tables import VERSION, latest, read_log, upsert, write_version
from pricetide.streaming.ingest import CLOCK, WATERMARK
from pricetide.streaming.online import use_state_store

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("minute", T.TimestampType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)
LATE = T.StructType([*BARS.fields[:2], T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType())])
# What leaves the operator: closed bars (``late`` false) and late ticks (``late`` true, with ts and seq).
OUTPUT = T.StructType([*BARS, *LATE.fields[2:], T.StructField("late", T.BooleanType())])
_STATE = "price double, ts long, seq long, volume double, n long"
# Versions of rebuilt bars begin here, above every batch number, so that they win over what the stream wrote.
REBUILT = 1 << 40


class BarProcessor(StatefulProcessor):
    """One open bar: its last price by (ts, seq), volume and tick count, until the watermark passes its end."""

    def __init__(self, width_seconds: int):
        self.width = width_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("bar", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == CLOCK:
            yield pd.DataFrame()
            return
        end = int(key[1].timestamp() * 1000) + self.width
        if end <= timerValues.getCurrentWatermarkInMs():
            for part in rows:
                yield _late(key, part)
            return
        price, ts, seq, volume, n = self.open.get() if self.open.exists() else (None, None, None, None, 0)
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            last = pd.DataFrame({"ts": micros, "seq": part["seq"]}).sort_values(["ts", "seq"]).index[-1]
            if ts is None or (int(micros[last]), int(part["seq"][last])) > (ts, seq):
                price, ts, seq = float(part["price"][last]), int(micros[last]), int(part["seq"][last])
            known = part["volume"].dropna()
            if len(known):
                volume = (volume or 0.0) + float(known.sum())
            n += len(part)
        if not self.open.exists():
            self.handle.registerTimer(end)
        self.open.update((price, ts, seq, volume, n))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        price, _, _, volume, n = self.open.get()
        self.open.clear()
        yield _rows(symbol=[key[0]], minute=[key[1]], price=[price], volume=[volume], n=[n], late=[False])

    def close(self) -> None:
        pass


def _rows(**columns) -> pd.DataFrame:
    out = pd.DataFrame(columns)
    for f in OUTPUT:
        if f.name not in out:
            out[f.name] = None
    out["volume"] = out["volume"].astype("float64")
    return out[OUTPUT.names].astype({"n": "Int64", "seq": "Int64"})


def _late(key, part: pd.DataFrame) -> pd.DataFrame:
    size = len(part)
    return _rows(symbol=[key[0]] * size, minute=[key[1]] * size, price=part["price"].to_list(), volume=part["volume"].to_list(), n=[1] * size, ts=part["ts"].to_list(), seq=part["seq"].to_list(), late=[True] * size)


def bars_and_late(ticks: DataFrame, width_seconds: int = 60, watermark: str = WATERMARK) -> DataFrame:
    """Closed bars and late ticks (OUTPUT) of a stream of (symbol, ts, seq, price, volume) that are not NULL but for the volume."""
    use_state_store(ticks.sparkSession)
    floor = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / width_seconds) * width_seconds)
    # The copy of the time has no watermark of its own: Spark would drop late rows before the operator sees them.
    copied = ticks.withWatermark("ts", watermark).select(
        "symbol", floor.alias("minute"), F.timestamp_micros(F.unix_micros("ts")).alias("ts"), "seq", "price", "volume"
    )
    return copied.groupBy("symbol", "minute").transformWithStateInPandas(
        statefulProcessor=BarProcessor(width_seconds), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def late_sink(bars_path: str, late_path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: closed bars into the bar log, late ticks into a side table, both under the batch's number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write_version(batch.where("not late").select(*BARS.names), bars_path, batch_id)
            write_version(batch.where("late").select(*LATE.names), late_path, batch_id)
        finally:
            batch.unpersist()

    return write


def touched_bars(spark: SparkSession, late_path: str, since: int = -1) -> DataFrame:
    """(symbol, minute) with late ticks in batches after ``since``."""
    late = read_log(spark, late_path, LATE)
    return late.where(F.col(VERSION) > since).select("symbol", "minute").distinct()


def rebuild(spark: SparkSession, ticks_path: str, schema: T.StructType, bars_path: str, late_path: str, run: int, width_seconds: int = 60, since: int = -1, ticks=lambda df: df) -> int:
    """Compute the bars that late ticks touch again, from all landed ticks; the number of bars rebuilt.

    Times of the touched bars bound the scan, the semi join keeps just their ticks. The result is one more version of
    the bar log (``run`` counts rebuilds): readers of the newest row per key see it at once, a repeated rebuild
    replaces itself. ``ticks`` turns landed rows into (symbol, ts, seq, price, volume).
    """
    touched = touched_bars(spark, late_path, since)
    first, last, n = touched.agg(F.min("minute"), F.max("minute"), F.count(F.lit(1))).first()
    if not n:
        return 0
    landed = ticks(read_if_exists(spark, ticks_path, schema))
    inside = (F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(last) + F.make_dt_interval(secs=F.lit(width_seconds)))
    floor = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / width_seconds) * width_seconds)
    again = landed.where(inside).withColumn("minute", floor).join(touched, ["symbol", "minute"], "left_semi")
    bars = again.groupBy("symbol", "minute").agg(
        F.max_by("price", F.struct("ts", "seq")).alias("price"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n")
    )
    upsert(bars, bars_path, ["symbol", "minute"], REBUILT + run, ["n"])
    return n


def stored_bars(spark: SparkSession, bars_path: str) -> DataFrame:
    """The newest row of every bar."""
    return latest(read_log(spark, bars_path, BARS), ["symbol", "minute"])
