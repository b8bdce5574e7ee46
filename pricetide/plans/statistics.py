"""The statistics of a stored feature table: correlations, bands, target distribution, classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import scalars as S
from pricetide.operators import evaluate as E
from pricetide.operators import stats as X
from pricetide.operators.series import Layout
from pricetide.session import stage
from pricetide.sources.readers import MissingColumns, between_days, normalize_columns


def load_table(df: DataFrame, layout: Layout) -> DataFrame:
    """A feature table under any accepted time column, with rows without a time dropped and the
    targets added."""
    df = normalize_columns(df)
    time = layout.order[0]
    if time not in df.columns:
        raise MissingColumns(f"no time column among {df.columns}")
    if dict(df.dtypes)[time] == "string":
        df = df.withColumn(time, S.to_time(time))
    return X.with_targets(df.where(F.col(time).isNotNull()), layout)


def statistics(
    df: DataFrame,
    layout: Layout,
    first=None,
    last=None,
    columns: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Every table of the statistics page for the days ``first``..``last`` (both included).

    The loaded table is written to the shared folder once, the frames read it and are lazy; ``price`` tables appear if there is a close or a
    price, ``target`` tables if there is a return to derive it from.
    """
    table = load_table(df, layout)
    time, by = layout.order[0], [layout.key]
    if first is not None and last is not None:
        table = between_days(table, time, first, last)
    table = stage(table, "statistics")
    out = {"bounds": X.bounds(table, time, by), "correlations": X.correlations(table, columns)}
    price = next((c for c in ("close", "price") if c in table.columns), None)
    if price is not None:
        out["bands"] = E.bands(table, price)
    if "target_pct" in table.columns:
        out["histogram"] = X.histogram(table, "target_pct", by=by)
        out["normal_curve"] = X.normal_curve(table, "target_pct", by=by)
        out["classes"] = X.class_counts(table, by=by)
    return out
