"""Stored tables: keyed upserts, insert-if-absent, key/value metadata, history, export.

There is no row update in parquet files. A keyed table is a log: every write adds rows with a
version, and readers take the newest row per key. Writing the same version again replaces it, so a
repeated batch changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.sources.readers import keep_first, keep_last, read_if_exists
from pricetide.sources.versions import DuplicateKeys, replace_table

__all__ = ["DuplicateKeys", "replace_table"]

VERSION = "version"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Give ``df`` the declared columns: missing ones are NULL, extra ones go."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Add (or replace) one version of a keyed log."""
    df.write.mode("overwrite").parquet(f"{path}/{VERSION}={version}")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_if_exists(spark, path, T.StructType([*schema, T.StructField(VERSION, T.LongType())]))


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str] = (VERSION,)) -> DataFrame:
    """The newest row of each key."""
    return keep_last(log, keys, order)


def prepare_predictions(df: DataFrame, schema: T.StructType, horizon_min: int) -> DataFrame:
    """Forecast rows ready to store: the target floored to its minute, rows without one skipped."""
    stamped = df.withColumn("target", F.date_trunc("minute", "target")).withColumn(
        "horizon_min", F.lit(horizon_min)
    )
    return conform(stamped.where(F.col("target").isNotNull()), schema)


def upsert(df: DataFrame, path: str, keys: Sequence[str], version: int, order: Sequence[str]) -> None:
    """Store a batch; inside it the last row of a key wins, across batches the newest version."""
    whole = df.dropna("any", subset=list(keys))
    write_version(keep_last(whole, keys, order), path, version)


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], out: str) -> None:
    """A keyed log with the newest row of every key alone, as one version; reads of it give what the log gives.

    Written beside the log, so that readers and a failed run keep the old one; the caller switches the path.
    """
    log = read_log(spark, path, schema)
    version = log.agg(F.max(VERSION)).first()[0]
    if version is not None:
        write_version(latest(log, keys).drop(VERSION), out, version)


def insert_if_absent(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The rows of ``batch`` to append: first of each key, and only keys the target lacks."""
    return keep_first(batch, keys, order).join(target.select(*keys), list(keys), "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keys that occur more than once, with the first row's order value and the surplus count."""
    return (
        df.groupBy(*keys)
        .agg(F.min(order).alias("first_row"), (F.count(F.lit(1)) - 1).alias("surplus"))
        .where(F.col("surplus") > 0)
    )


def write_history(df: DataFrame, path: str, day: str) -> int:
    """Daily history as a new version of its table, one directory per year; its number."""
    return replace_table(df.withColumn("year", F.year(day)), path, unique=[day], by=["year"])


def meta_row(spark: SparkSession, key: str, value: object) -> DataFrame:
    """One metadata row; anything but text is stored as JSON."""
    text = value if isinstance(value, str) else json.dumps(value)
    return spark.range(1).select(
        F.lit(key).alias("key"), F.lit(text).alias("value"), F.current_timestamp().alias("updated_at")
    )


def meta_from(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """Metadata rows from a struct, encoded as JSON without leaving Spark."""
    return df.select(
        key.alias("key"),
        F.to_json(value).alias("value"),
        F.current_timestamp().alias("updated_at"),
    )


def meta_latest(meta: DataFrame) -> DataFrame:
    return keep_last(meta, ["key"], ["updated_at", "value"])


def meta_decoded(meta: DataFrame, schema: str) -> DataFrame:
    """Newest value per key: ``decoded`` where the text is such JSON, ``text`` always."""
    decoded = F.from_json("value", schema)
    return meta_latest(meta).select("key", decoded.alias("decoded"), F.col("value").alias("text"))


# The columns of the metrics export, in order, with the header each one gets.
EXPORT_COLUMNS = {
    "target": "Datetime",
    "price_real": "Price_real",
    "y_hat": "y_hat",
    "erro": "erro",
    "erro_base": "erro_base",
    "acerto_dir": "acerto_dir",
    "y_hat_ret": "y_hat_ret",
    "baseline": "baseline",
}


def export_frame(evaluated: DataFrame) -> DataFrame:
    return evaluated.select(*[F.col(c).alias(name) for c, name in EXPORT_COLUMNS.items()])


def export_metrics(evaluated: DataFrame, path: str) -> None:
    """The metrics as CSV with a header and as parquet."""
    frame = export_frame(evaluated)
    frame.write.mode("overwrite").csv(f"{path}/csv", header=True)
    frame.write.mode("overwrite").parquet(f"{path}/parquet")
