"""The engine's input tables, derived from the given test tables by Spark.

A symbol is an event type, a price is 100 + value/100 (so that returns stay inside the clips), the
volume is the ``k`` of the JSON properties. Times are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions import scalars as S
from pricetide.operators.bars import bars
from pricetide.operators.evaluate import evaluated
from pricetide.operators.series import Layout, home_rows, series
from pricetide.session import configure, stage
from pricetide.sources.readers import read_table

# An hour bar series has at most 1440 rows in such a cell, a daily one 1440 days.
HOUR_LAYOUT = Layout(order=("minute",), cell_seconds=3600 * 1440)
TARGET_LAYOUT = Layout(order=("target",), cell_seconds=3600 * 1440)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(configure(spark), f"{sf_dir.rstrip('/')}/{name}.parquet")


def base_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.lit(100.0) + F.col("value") / 100.0).alias("price"),
        F.get_json_object("props", "$.k").try_cast("double").alias("volume"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with the day's opening price; one row per (symbol, day) is joined back."""
    base = base_ticks(spark, sf_dir).withColumn("day", F.to_date("ts"))
    opens = base.groupBy("symbol", "day").agg(F.min_by("price", F.struct("ts", "seq")).alias("open"))
    # A left join on the grouping key: Spark leaves it out of passes that do not need the open.
    joined = base.join(opens, ["symbol", "day"], "left").drop("day")
    return joined.withColumn("return_pct", S.tick_return_pct("price", "open"))


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty text input: every tick twice, the later copy a cent higher; by the JSON value some
    times and some prices are no such thing."""
    base = base_ticks(spark, sf_dir)
    again = base.withColumns({"seq": F.col("seq") + 1000000000, "price": F.col("price") + 0.01})
    both = base.unionByName(again)
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    later = F.col("seq") >= 1000000000
    return both.select(
        "symbol",
        F.when(F.col("volume") == 0, F.lit("NaT")).otherwise(text).alias("ts"),
        "seq",
        F.when((F.col("volume") == 1) & ~later, F.lit("abc"))
        .when((F.col("volume") == 2) & later, F.lit("abc"))
        .otherwise(F.col("price").cast("string"))
        .alias("price"),
        "volume",
    )


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(base_ticks(spark, sf_dir), "hour")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-bar-ahead forecasts of three simple members with equal weights."""
    df, cut = series(hour_bars(spark, sf_dir).select("symbol", "minute", "price"), HOUR_LAYOUT, back=2)
    df = home_rows(
        df.withColumns(
            {
                "y_hat_ridge": F.avg("price").over(cut.last(3)),
                "_prev": F.lag("price").over(cut.rows()),
            }
        )
    )
    members = df.select(
        "symbol",
        (F.col("minute") + F.expr("interval 1 hour")).alias("target"),
        F.col("price").alias("baseline"),
        F.col("price").alias("y_hat_sgd"),
        "y_hat_ridge",
        (2 * F.col("price") - F.coalesce("_prev", "price")).alias("y_hat_pa"),
    )
    members = members.withColumn(
        "y_hat", (F.col("y_hat_sgd") + F.col("y_hat_ridge") + F.col("y_hat_pa")) / 3.0
    )
    third = F.lit(1.0) / F.lit(3.0)
    return members.withColumns(
        {
            "y_hat_ret": F.col("y_hat") / F.col("baseline") - 1.0,
            "w_sgd": third,
            "w_ridge": third,
            "w_pa": third,
        }
    )


# Three assets named like languages of posts, by return flag of a line and status of an order.
def _asset(column: str, first: str, second: str) -> Column:
    return F.when(F.col(column) == first, "de").when(F.col(column) == second, "en").otherwise("fr")


def asset_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily open, high, low, close, volume of three assets."""
    return daily(spark, sf_dir, _asset("l_returnflag", "A", "N"))


def asset_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated events of three assets."""
    return calendar(spark, sf_dir, _asset("o_orderstatus", "F", "O"))


def daily(spark: SparkSession, sf_dir: str, symbol: Column | None = None) -> DataFrame:
    """Daily open, high, low, close, volume of the shipped goods: one series, or one per ``symbol``."""
    symbol = F.lit("goods") if symbol is None else symbol
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    price = F.col("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(symbol.alias("symbol"), F.to_date("l_shipdate").alias("d"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def calendar(spark: SparkSession, sf_dir: str, asset: Column | None = None) -> DataFrame:
    """Dated events: two order priorities stand for the two event kinds, the others are other kinds."""
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "halving")
        .when(F.col("o_orderpriority") == "2-HIGH", "fork")
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, sf_dir, "orders").select(
        (F.lit("goods") if asset is None else asset).alias("ativo"), F.to_date("o_orderdate").alias("data"), kind.alias("evento")
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as posts of the asset named by their language."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("ativo"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 31).cast("int")).alias("data"),
        S.strip("text").alias("texto_original"),
        "source",
        F.col("doc_id").alias("seq"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case words of the benchmark texts with a score from their length, as a stored table."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.split(F.lower("text"), "[\\t\\n\\f\\r ]+")).alias("word")
    )
    score = (F.length("word") % 5 - 2) / 2.0
    return stage(words.where("word != ''").distinct().withColumn("score", score), "lexicon")


def evaluated_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(preds(spark, sf_dir), hour_bars(spark, sf_dir))


def gapped_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, without a forecast of one member in every fifth hour of the day."""
    rows = evaluated_preds(spark, sf_dir)
    return rows.withColumn("y_hat_ridge", F.when(F.hour("target") % 5 != 0, F.col("y_hat_ridge")))
