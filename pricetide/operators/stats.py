"""Descriptive statistics of a feature table."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.operators.series import Layout, home_rows, per_series, series
from pricetide.sources.readers import numeric_columns


def with_targets(df: DataFrame, layout: Layout, null_as_zero: bool = False) -> DataFrame:
    """Add what is missing of ``target_pct`` (next row's return) and ``target_bin`` (is it positive)."""
    source = next((c for c in ("return_pct", "ret") if c in df.columns), None)
    if "target_pct" not in df.columns and source is not None:
        rows, cut = series(df, layout, ahead=1)
        rows = rows.withColumn("target_pct", F.lead(source).over(cut.rows()))
        df = home_rows(rows).drop("gi")
    if "target_bin" not in df.columns and "target_pct" in df.columns:
        up = (F.col("target_pct") > 0).cast("int")
        df = df.withColumn("target_bin", F.coalesce(up, F.lit(0)) if null_as_zero else up)
    return df


def default_columns(df: DataFrame) -> list[str]:
    """Numeric columns in name order without the targets."""
    return sorted(numeric_columns(df, exclude=("target_bin", "target_pct")))


# Columns of a block of the correlation matrix.
CORR_BLOCK = 8


def correlations(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2, block: int = CORR_BLOCK) -> DataFrame:
    """Pearson matrix as rows (a, b, r), rounded half to even; a pair uses the rows where both values exist.

    The columns are cut into blocks. Every row is paired with itself once for each two blocks, and one aggregation by
    the pair of blocks has the co-moments of ``block`` x ``block`` columns, partial before the shuffle: a plan of one size for any
    number of columns, and a shuffle of one row for each two blocks and task.
    """
    columns = list(columns) if columns is not None else default_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    block = min(block, len(columns))
    cuts = [columns[k : k + block] for k in range(0, len(columns), block)]
    padded = [[*(F.col(f"`{c}`").cast("double") for c in cut), *[F.lit(None).cast("double")] * (block - len(cut))] for cut in cuts]
    blocks = df.select(F.array(*[F.array(*cut) for cut in padded]).alias("_x"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(cuts) - 1)), lambda i: F.transform(F.sequence(i, F.lit(len(cuts) - 1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    both = blocks.select("_x", F.explode(pairs).alias("_p"))
    both = both.select("_p.i", "_p.j", F.get("_x", F.col("_p.i")).alias("_l"), F.get("_x", F.col("_p.j")).alias("_r"))
    values = [F.get("_l", F.lit(k)).alias(f"_l{k}") for k in range(block)] + [F.get("_r", F.lit(k)).alias(f"_r{k}") for k in range(block)]
    cells = both.select("i", "j", *values).groupBy("i", "j").agg(*[F.corr(f"_l{m}", f"_r{n}").alias(f"_{m}_{n}") for m in range(block) for n in range(block)])
    names = F.from_json(F.lit(json.dumps(columns)), "array<string>")
    entry = lambda m, n: F.struct((F.col("i") * block + m).alias("m"), (F.col("j") * block + n).alias("n"), F.col(f"_{m}_{n}").alias("r"))
    long = cells.select("i", "j", F.inline(F.array(*[entry(m, n) for m in range(block) for n in range(block)])))
    # A pair of different blocks stands for both orders.
    turned = F.when(F.col("i") == F.col("j"), F.array(F.struct("m", "n", "r"))).otherwise(
        F.array(F.struct("m", "n", "r"), F.struct(F.col("n").alias("m"), F.col("m").alias("n"), "r"))
    )
    whole = long.where((F.col("m") < len(columns)) & (F.col("n") < len(columns))).select(F.inline(turned))
    return whole.select(F.get(names, F.col("m")).alias("a"), F.get(names, F.col("n")).alias("b"), F.bround("r", digits).alias("r"))


def histogram(df: DataFrame, column: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the extremes: every bin with its count and probability density."""
    values = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_x"))
    edges = values.groupBy(*by).agg(
        F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("total")
    )
    edges = per_series(edges.where("total > 0"), "edges")
    width = F.col("hi") - F.col("lo")
    place = F.floor(F.try_divide(F.col("_x") - F.col("lo"), width) * bins)
    # Without groups ``edges`` is a single row.
    binned = (values.join(edges, list(by)) if by else values.join(F.broadcast(edges))).withColumn(
        "bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    )
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = width / bins
    return every.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("lo") + F.col("bin") * step).alias("left_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(F.try_divide("n", F.col("total") * step), F.lit(0.0)).alias("density"),
    )


def normal_curve(df: DataFrame, column: str, points: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """The normal density with the column's mean and population deviation between its extremes.

    Zeros for a deviation of 0; no rows with five values or fewer.
    """
    stats = df.groupBy(*by).agg(
        F.count(column).alias("_n"),
        F.avg(column).alias("_mu"),
        F.stddev_pop(column).alias("_sd"),
        F.min(column).alias("_lo"),
        F.max(column).alias("_hi"),
    )
    grid = stats.where("_n > 5").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / (points - 1)
    return grid.withColumn("x", x).select(*by, "i", "x", _density("x", "_mu", "_sd").alias("pdf"))


def _density(x: str, mu: str, sd: str) -> Column:
    z = (F.col(x) - F.col(mu)) / F.col(sd)
    height = F.exp(-0.5 * z * z) / (F.col(sd) * math.sqrt(2.0 * math.pi))
    return F.when(F.col(sd) > 0, height).otherwise(F.lit(0.0))


def class_counts(df: DataFrame, column: str = "target_bin", by: Sequence[str] = ()) -> DataFrame:
    """Rows per class 0 and 1; a class without rows counts 0."""
    counts = df.groupBy(*by).agg(
        F.count_if(F.col(column) == 0).alias("c0"), F.count_if(F.col(column) == 1).alias("c1")
    )
    down = F.struct(F.lit(0).alias("classe"), F.col("c0").alias("n"))
    up = F.struct(F.lit(1).alias("classe"), F.col("c1").alias("n"))
    return counts.select(*by, F.inline(F.array(down, up)))


def freshness(df: DataFrame, day: str, as_of: Column, by: Sequence[str] = ()) -> DataFrame:
    """Newest day, whether it is the day before ``as_of``, and the days between."""
    newest = df.groupBy(*by).agg(F.max(F.to_date(day)).alias("last_date"))
    gap = F.datediff(as_of, "last_date")
    return newest.select(*by, "last_date", (gap == 1).alias("is_fresh"), gap.alias("days_behind"))


def bounds(df: DataFrame, day: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(F.to_date(day)).alias("first_date"), F.max(F.to_date(day)).alias("last_date")
    )


def zscore(df: DataFrame, column: str, out: str, key: str = "symbol") -> DataFrame:
    """Distance from the series mean in sample deviations, 0 where there is no deviation.

    The join brings one row per series back to the data instead of a window over the series.
    """
    stats = df.groupBy(key).agg(F.avg(column).alias("_mu"), F.stddev_samp(column).alias("_sd"))
    score = F.when(F.col("_sd") > 0, (F.col(column) - F.col("_mu")) / F.col("_sd")).otherwise(F.lit(0.0))
    return df.join(per_series(stats, "zscore"), key).withColumn(out, score).drop("_mu", "_sd")
