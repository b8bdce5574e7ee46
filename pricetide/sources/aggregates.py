"""Stored means that grow with every batch: sums and counts by key, added up when they are read.

A batch stores the sum and the count of its own rows alone, under its version, so nothing that is already stored is read again.
Sums and counts of any batches add up; writing a version again replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.sources.tables import VERSION, read_log, write_version

TOTAL, COUNT = "total", "n"


def _schema(keys: T.StructType) -> T.StructType:
    return T.StructType([*keys, T.StructField(TOTAL, T.DoubleType()), T.StructField(COUNT, T.LongType())])


def add_batch(rows: DataFrame, value: str, keys: Sequence[str], path: str, version: int) -> None:
    """Store what ``rows`` add to the mean of ``value`` by ``keys``; values that are NULL don't count."""
    known = rows.where(F.col(value).isNotNull())
    write_version(known.groupBy(*keys).agg(F.sum(value).alias(TOTAL), F.count(F.lit(1)).alias(COUNT)), path, version)


def stored_means(spark: SparkSession, path: str, keys: T.StructType, name: str) -> DataFrame:
    """The mean of every key over all batches, and how many values it has (``n``)."""
    log = read_log(spark, path, _schema(keys))
    sums = log.groupBy(*keys.names).agg(F.sum(TOTAL).alias(TOTAL), F.sum(COUNT).alias(COUNT))
    return sums.select(*keys.names, (F.col(TOTAL) / F.col(COUNT)).alias(name), COUNT)


def compact_sums(spark: SparkSession, path: str, keys: T.StructType, out: str) -> None:
    """The same sums with one row for every key, as one version at ``out``; later batches need a higher number."""
    log = read_log(spark, path, _schema(keys))
    version = log.agg(F.max(VERSION)).first()[0]
    if version is not None:
        sums = log.groupBy(*keys.names).agg(F.sum(TOTAL).alias(TOTAL), F.sum(COUNT).alias(COUNT))
        write_version(sums, out, version)
