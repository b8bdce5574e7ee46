"""Reading and cleaning input tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.functions import scalars as S
from pricetide.session import stage

# The spellings accepted for each column.
COLUMN_NAMES = {
    "Datetime": "ts",
    "Date": "ts",
    "date": "ts",
    "Symbol": "symbol",
    "Price": "price",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "adj_close",
    "Volume": "volume",
    "Return_%": "return_pct",
}


class MissingColumns(ValueError):
    """The input lacks columns a job needs."""


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet table; no order is imposed, the operators sort inside their windows."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_if_exists(
    spark: SparkSession, path: str, schema: T.StructType, condition: Column | None = None
) -> DataFrame:
    """The table, or an empty frame of that schema; ``condition`` is pushed into the scan."""
    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    return df if condition is None else df.where(condition)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Bring known column spellings to one name; a column that has it already wins."""
    renames = {}
    for old, new in COLUMN_NAMES.items():
        if old in df.columns and new not in df.columns and new not in renames.values():
            renames[old] = new
    return df.withColumnsRenamed(renames)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    return df


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in ``order``; each input task already drops all but one copy."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    oldest = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(oldest)).where("_rn = 1").drop("_rn")


def clean_ticks(raw: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Parse times and numbers, keep the last row per (symbol, ts), drop rows without a price.

    The duplicate goes before the price check: a later row with a bad price still replaces the
    earlier one and then falls out.
    """
    parsed = raw.withColumn(ts, S.to_time(ts)).where(F.col(ts).isNotNull())
    last = keep_last(parsed, ["symbol", ts], [seq])
    numbers = {c: S.to_number(c) for c in ("price", "open", "volume") if c in last.columns}
    return last.withColumns(numbers).where(F.col("price").isNotNull())


def purge_bad_keys(df: DataFrame, key: str) -> DataFrame:
    """Drop rows whose key is NULL, empty or not a time."""
    return df.where(S.to_time(key).isNotNull())


def project_ticks(feed: DataFrame) -> DataFrame:
    """A landed exchange feed (symbol, epoch_ms, last, open, base_volume) as ticks."""
    return feed.select(
        "symbol",
        F.timestamp_millis("epoch_ms").alias("ts"),
        F.col("last").alias("price"),
        "open",
        F.col("base_volume").alias("volume"),
        S.tick_return_pct("last", "open").alias("return_pct"),
    )


def between_days(df: DataFrame, ts: str, first, last) -> DataFrame:
    """Rows of the days ``first``..``last``, both included, as a range the scan can push down."""
    begin = F.lit(first).cast("date")
    end = F.date_add(F.lit(last).cast("date"), 1)
    kind = df.schema[ts].dataType
    return df.where((F.col(ts) >= begin.cast(kind)) & (F.col(ts) < end.cast(kind)))


def with_history(df: DataFrame, key: str, at_least: int) -> DataFrame:
    """Rows of those series that have at least so many rows.

    The list of series is written once, so the join with the data is planned on its real size.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    return df.join(stage(counts.select(key), "history"), key, "left_semi")


def read_posts(feeds: Sequence[DataFrame]) -> DataFrame:
    """Posts of several feeds (ativo, title, created_utc): trimmed, non-empty, dated in UTC."""
    posts = feeds[0]
    for feed in feeds[1:]:
        posts = posts.unionByName(feed, allowMissingColumns=True)
    return (
        posts.withColumn("texto_original", S.strip("title"))
        .where(F.col("texto_original") != "")
        .withColumn("data", F.to_date(F.timestamp_seconds(F.coalesce("created_utc", F.lit(0)))))
        .drop("title", "created_utc")
    )
