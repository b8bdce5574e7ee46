"""Tables in order: written so that files and rows follow an order, read by ranges that leave most of them out.

The rows are dealt by ranges of the order and sorted inside each task. A day's rows stand together in its directory, so a
range of days reads just those directories; inside them, files follow each other in order, and the statistics
of files and row groups leave out those beyond a range of the order's first column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.sources.readers import read_if_exists
from pricetide.sources.tables import VERSION, latest, read_log


def write_ordered(df: DataFrame, path: str, order: Sequence[str | Column], by: Sequence[str] = (), mode: str = "overwrite", tasks: int | None = None) -> None:
    """Write ``df`` so that files in the order of their names hold the rows in the order of ``by``, then ``order``.

    Spark picks the ranges from a sample of the rows, so a directory with very many rows is spread over several tasks (and
    files), each with a stretch of it. ``tasks`` fixes their number.
    """
    keys = [*(F.col(c) for c in by), *(F.col(c) if isinstance(c, str) else c for c in order)]
    dealt = df.repartitionByRange(tasks, *keys) if tasks else df.repartitionByRange(*keys)
    writer = dealt.sortWithinPartitions(*keys).write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def scan_range(df: DataFrame, column: str, first, last, order: Sequence[str | Column] = ()) -> DataFrame:
    """Rows with ``first`` <= column <= ``last``, in order if one is given.

    The bounds are literals, so on a table laid out by ``column`` Spark lists and opens the matching directories alone.
    """
    kind = df.schema[column].dataType
    inside = df.where(F.col(column).between(F.lit(first).cast(kind), F.lit(last).cast(kind)))
    return inside.orderBy(*order) if order else inside


def posts_between(spark: SparkSession, path: str, schema: T.StructType, first, last, asset: str | None = None) -> DataFrame:
    """Stored posts of the days ``first``..``last``, newest first; within a day by asset and text. An absent table has none."""
    posts = read_if_exists(spark, path, schema, F.col("ativo") == asset if asset is not None else None)
    return scan_range(posts, "data", first, last, [F.desc("data"), "ativo", "texto_original"])


def means_between(spark: SparkSession, path: str, schema: T.StructType, first, last, asset: str | None = None) -> DataFrame:
    """The newest day means of the days ``first``..``last``, oldest first; the range is cut before versions are compared."""
    log = read_log(spark, path, schema)
    log = log.where(F.col("ativo") == asset) if asset is not None else log
    newest = latest(scan_range(log, "data", first, last), ["ativo", "data"])
    return newest.drop(VERSION).orderBy("data", "ativo")
