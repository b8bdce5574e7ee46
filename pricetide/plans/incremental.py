"""The daily indicators kept up to date: a refresh computes the new days alone, from the rows before them.

What a row's indicators take from far back has faded below double precision after ``daily.look_back`` rows, and how many
rows a series has is a number of its newest stored row. So a refresh reads that many newest rows of the
stored table and the new days, and what it appends is what a computation of everything would give for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.operators.series import Layout, per_series, tail_rows
from pricetide.plans.daily import INDICATORS, LAYOUT, REQUIRED, daily_indicators, look_back
from pricetide.session import scratch
from pricetide.sources.tables import VERSION, read_log, write_version

_TYPES = {"symbol": T.StringType(), "d": T.DateType(), "gi": T.LongType()}
TABLE = T.StructType([T.StructField(c, _TYPES.get(c, T.DoubleType())) for c in ("symbol", *REQUIRED, "gi", *INDICATORS)])


def refresh(spark: SparkSession, history: DataFrame, path: str, run: int, layout: Layout = LAYOUT) -> None:
    """Append the indicators of the days of ``history`` that are newer than the newest stored day of their symbol.

    ``history`` has ``daily.REQUIRED`` for each symbol; only its new days are used, so where no new symbol can appear it
    may be cut to them before, which prunes its scan. ``run`` numbers the refreshes: the same run again writes the same rows, since it looks at earlier runs alone. A
    revised day of the past changes nothing here; then the table is built anew at another path.
    """
    with scratch(spark):
        stored = read_log(spark, path, TABLE).where(F.col(VERSION) < run).drop(VERSION)
        newest = per_series(stored.groupBy("symbol").agg(F.max("d").alias("_last")), "newest")
        fresh = history.select("symbol", *REQUIRED).dropna("any").join(newest, "symbol", "left")
        fresh = fresh.where(F.col("_last").isNull() | (F.col("d") > F.col("_last"))).drop("_last")
        before = tail_rows(stored, layout, look_back(layout)).select("symbol", *REQUIRED, "gi")
        before = per_series(before, "before")
        first = before.groupBy("symbol").agg(F.min("gi").alias("_first"))
        rows = before.drop("gi").unionByName(fresh)
        computed = daily_indicators(rows, layout).join(newest, "symbol", "left").join(first, "symbol", "left")
        new = computed.where(F.col("_last").isNull() | (F.col("d") > F.col("_last")))
        new = new.withColumn("gi", F.col("gi") + F.coalesce("_first", F.lit(0)))
        write_version(new.select(*TABLE.names), path, run)


def indicators(spark: SparkSession, path: str) -> DataFrame:
    """The stored indicators, as ``daily_indicators`` gives them; ``daily.completed`` makes the feature table of them."""
    return read_log(spark, path, TABLE).drop(VERSION)
