"""Streams of ticks: landing, duplicate suppression, bars, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pricetide.sources.readers import keep_last
from pricetide.sources.tables import write_version

WATERMARK = "10 minutes"
# The symbol of rows that only say how late it is: at the end of a replay they move the watermark on.
CLOCK = ""


def tick_stream(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int = 64
) -> DataFrame:
    """Landed parquet files as a stream; a message source can take its place."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def without_duplicates(ticks: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """The first row per (symbol, ts); later copies are ignored while the watermark remembers them."""
    return ticks.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["symbol", "ts"])


def stream_bars(ticks: DataFrame, width: str = "1 minute", watermark: str | None = WATERMARK) -> DataFrame:
    """Tumbling bars: last price by (ts, seq), volume, tick count. Pass ``watermark=None`` for a
    stream that already has one."""
    if watermark is not None:
        ticks = ticks.withWatermark("ts", watermark)
    return (
        ticks.groupBy("symbol", F.window("ts", width).alias("_w"))
        .agg(
            F.max_by("price", F.struct("ts", "seq")).alias("price"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n"),
        )
        .select("symbol", F.col("_w.start").alias("minute"), "price", "volume", "n")
    )


def upsert_sink(path: str, keys: Sequence[str], order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A batch writer whose version is the batch number: a repeated batch replaces itself.

    Of rows with equal keys in one batch the last by ``order`` stays; without an order any one of them, but just one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropna("any", subset=list(keys))
        write_version(keep_last(rows, keys, order or keys), path, batch_id)

    return write


def without_clock(sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink that never sees rows of the clock. The stream must keep them up to here: a filter in its plan would
    be moved in front of the watermark."""
    return lambda batch, batch_id: sink(batch.where(F.col("symbol") != CLOCK), batch_id)


def land(df: DataFrame, path: str, order: str, parts: int, kind: str = "parquet") -> None:
    """Land the rows of ``df`` as ``parts`` files that follow each other in ``order`` (a time or number), as a feed would: for replays."""
    number = F.col(order).cast("double")
    low, high = df.agg(F.min(number), F.max(number)).first()
    place = F.lit(0) if low is None else F.least(F.floor((number - low) / max(high - low, 1e-6) * parts), F.lit(parts - 1))
    for k in range(parts if low is not None else 1):
        df.where(place == k).coalesce(1).write.mode("append").format(kind).save(path)


def land_clock(spark: SparkSession, path: str, schema: T.StructType, time: str, at) -> None:
    """Land one row of the clock for the time ``at``, after everything else."""
    columns = [
        (F.lit(CLOCK) if f.name == "symbol" else F.lit(at) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    spark.range(1).select(*columns).coalesce(1).write.mode("append").parquet(path)


def start(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = "60 seconds",
) -> StreamingQuery:
    """Run a stream into a batch writer, each ``every``; with None it works off what is there and ends."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
