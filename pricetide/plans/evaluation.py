"""Batch jobs over the stored tables: tick intake, evaluation of forecasts, daily sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide import schemas
from pricetide.operators import evaluate as E
from pricetide.operators.bars import bars
from pricetide.operators.sentiment import daily_means, polarity, with_text_key
from pricetide.operators.series import Layout
from pricetide.session import scratch, stage
from pricetide.sources import tables as W
from pricetide.sources.readers import keep_first, project_ticks, read_if_exists

TICK_KEY = ("symbol", "ts")


def _stored_days(spark: SparkSession, path: str, schema: T.StructType, day: str, batch: DataFrame) -> DataFrame:
    """The part of a table laid out by day that a batch can collide with.

    The batch's days are written once. Their first and last prune the table's directories before
    anything is read, the join leaves out the days between them that the batch does not have.
    """
    days = stage(batch.select(day).distinct(), "days")
    first, last = days.agg(F.min(day), F.max(day)).first()
    stored = read_if_exists(spark, path, schema, F.col(day).between(F.lit(first), F.lit(last)))
    return stored.join(days, day, "left_semi")


def take_ticks(feed: DataFrame, path: str) -> None:
    """Append the feed's ticks whose (symbol, ts) the table does not hold yet."""
    batch = project_ticks(feed).withColumn("day", F.to_date("ts"))
    schema = T.StructType([*schemas.TICKS, T.StructField("day", T.DateType())])
    with scratch(feed.sparkSession):
        stored = _stored_days(feed.sparkSession, path, schema, "day", batch)
        fresh = W.insert_if_absent(stored, batch, TICK_KEY, ["price", "volume"])
        fresh.write.mode("append").partitionBy("day").parquet(path)


def rewrite_unique(ticks: DataFrame, path: str, order: tuple[str, ...]) -> int:
    """The table without duplicates, the first row of each (symbol, ts), as the next version at ``path``; its number."""
    unique = keep_first(ticks, TICK_KEY, order).withColumn("day", F.to_date("ts"))
    return W.replace_table(unique, path, by=["day"])


def load_forecasts(spark: SparkSession, path: str, horizon_min: int) -> DataFrame:
    """The newest forecast per (symbol, target); an absent table is empty."""
    schema = schemas.PREDICTIONS if horizon_min == 1 else schemas.PREDICTIONS_H30
    return W.latest(W.read_log(spark, path, schema), ["symbol", "target"])


def evaluation(
    ticks: DataFrame, preds: DataFrame, layout: Layout, hours: int | None = None, seq: str = "seq"
) -> dict[str, DataFrame]:
    """Rows with errors, figures per symbol, bands of actual and forecast, newest values."""
    minute = bars(ticks, "minute", seq)
    rows = E.evaluated(preds, minute)
    if hours is not None:
        rows = E.recent(rows, hours, layout)
    # Every frame reads the joined rows from here.
    rows = stage(rows, "evaluation")
    return {
        "rows": rows,
        "figures": E.kpis(rows),
        "bands_real": E.bands(rows, "price_real"),
        "bands_forecast": E.bands(rows, "y_hat"),
        "latest": E.latest_values(rows, minute),
        "heatmap": E.heatmap(rows),
    }


def take_posts(posts: DataFrame, lexicon: DataFrame, path: str, means_path: str, version: int, seq: str) -> None:
    """Store new posts with their polarity, and the day means of the stored posts they touch.

    The mean of a day covers every stored post of that day, not only those of the batch.
    """
    spark, keys = posts.sparkSession, ["ativo", "data", "text_key"]
    keyed = with_text_key(posts, "texto_original")
    with scratch(spark):
        stored = with_text_key(_stored_days(spark, path, schemas.POSTS, "data", posts), "texto_original")
        fresh = W.insert_if_absent(stored, keyed, keys, [seq])
        scores = polarity(fresh, lexicon, "texto_original", keys)
        scored = fresh.select(*keys, "texto_original").join(scores, keys).drop("text_key")
        W.conform(scored, schemas.POSTS).write.mode("append").partitionBy("data").parquet(path)
        touched = stage(posts.select("ativo", "data").distinct(), "touched")
        everything = _stored_days(spark, path, schemas.POSTS, "data", touched).join(touched, ["ativo", "data"], "left_semi")
        W.upsert(daily_means(everything), means_path, ["ativo", "data"], version, ["media_sentimento"])
