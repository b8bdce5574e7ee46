"""Ticks stored by (symbol, time cell): buckets that numbering, bars and joins read without an exchange.

A bucket holds whole cells, so what is grouped, numbered or joined by symbol and cell stays in its task. A symbol's
cells are spread over the buckets by their hash, so a symbol with a third of all ticks fills all of them alike. Inside a
file rows are sorted by symbol, cell and the order of the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.operators.evaluate import with_errors
from pricetide.operators.series import CELL, Layout, with_cell

BUCKETS = 64


def write_clustered(ticks: DataFrame, table: str, path: str, layout: Layout = Layout(), buckets: int = BUCKETS) -> DataFrame:
    """Store ``ticks`` at ``path`` as the catalog's table ``table``, and read it.

    One shuffle deals the cells to the buckets' tasks, so every bucket is one sorted file.
    """
    dealt = with_cell(ticks, layout).repartition(buckets, layout.key, CELL)
    order = [layout.key, CELL, *layout.order]
    dealt.sortWithinPartitions(*order).write.bucketBy(buckets, layout.key, CELL).sortBy(*order).option("path", path).mode("overwrite").saveAsTable(table)
    return dealt.sparkSession.table(table)


def attach(spark: SparkSession, table: str, path: str, schema: T.StructType, layout: Layout = Layout(), buckets: int = BUCKETS) -> DataFrame:
    """The stored ticks in a session whose catalog does not know them; ``schema`` is that of the table."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    order = ", ".join(f"`{c}`" for c in (layout.key, CELL, *layout.order))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (`{layout.key}`, `{CELL}`) "
        f"SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def clustered_bars(ticks: DataFrame, unit: str = "minute", seq: str = "seq") -> DataFrame:
    """``bars.bars`` of clustered ticks, without an exchange; the bars keep their cell.

    ``unit`` must divide the cell, so that a bar's ticks are in one cell.
    """
    return ticks.groupBy("symbol", CELL, F.date_trunc(unit, "ts").alias("minute")).agg(
        F.max_by("price", F.struct("ts", seq)).alias("price"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n")
    )


def evaluated_clustered(preds: DataFrame, bars: DataFrame, anchor: str = "baseline") -> DataFrame:
    """``evaluate.evaluated`` of forecasts clustered by the cell of their target, with bars of the same cells.

    Spark joins without a shuffle by just the columns that both sides are stored by. So a cell's prices become one
    map, and a forecast looks up its target there; ``cell_seconds`` should be some dozen bars. Bars are unique by time.
    """
    prices = bars.groupBy("symbol", CELL).agg(F.map_from_entries(F.collect_list(F.struct("minute", "price"))).alias("_prices"))
    joined = preds.join(prices, ["symbol", CELL], "left")
    return with_errors(joined.withColumn("price_real", F.try_element_at("_prices", F.col("target"))).drop("_prices", CELL), anchor)
