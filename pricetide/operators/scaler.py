"""Expanding standardisation: each row is scaled by the mean and deviation up to itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators.series import Layout, earlier_totals, join_runs
from pricetide.session import stage


def expanding(df: DataFrame, layout: Layout, columns: Sequence[str]) -> DataFrame:
    """Add ``<c>_mean``, ``<c>_std`` (population) and ``<c>_scaled`` for each column.

    Every run is summarised by count, mean and squared deviation; the summaries of earlier runs are
    merged, and each row merges them with its own run up to itself. A deviation of 0 scales by 1.
    """
    key = layout.key
    own = {c: F.when(F.col("home"), F.col(c).cast("double")) for c in columns}
    aggs = []
    for c in columns:
        aggs += [F.count(own[c]).alias(f"_n_{c}"), F.avg(own[c]).alias(f"_m_{c}")]
        aggs += [F.var_pop(own[c]).alias(f"_v_{c}")]
    # A row for each run, read several times below.
    runs = stage(df.groupBy(key, "chunk").agg(*aggs), "scaler-runs")
    # Sums are taken around the first run's mean, which keeps squares of large values small.
    known = {c: F.when(F.col(f"_m_{c}").isNotNull(), F.col("chunk")) for c in columns}
    runs = runs.join(runs.groupBy(key).agg(*[F.min_by(f"_m_{c}", known[c]).alias(f"_c_{c}") for c in columns]), key)
    merged = {}
    for c in columns:
        n, shift = F.col(f"_n_{c}"), F.col(f"_m_{c}") - F.col(f"_c_{c}")
        square = F.col(f"_v_{c}") * n + n * shift * shift
        merged |= {f"_n0_{c}": ("sum", n), f"_s0_{c}": ("sum", n * shift), f"_q0_{c}": ("sum", square)}
    runs = earlier_totals(runs, key, "chunk", merged, layout.group_rows).select(key, "chunk", *merged, *[f"_c_{c}" for c in columns])

    local = {}
    for c in columns:
        local[f"_n1_{c}"] = F.count(own[c]).over(layout.upto())
        local[f"_m1_{c}"] = F.avg(own[c]).over(layout.upto())
        local[f"_v1_{c}"] = F.var_pop(own[c]).over(layout.upto())
    out = join_runs(df, layout, runs).withColumns(local)
    for c in columns:
        n0, n1 = F.col(f"_n0_{c}"), F.col(f"_n1_{c}")
        here = F.coalesce(F.col(f"_m1_{c}") - F.col(f"_c_{c}"), F.lit(0.0))
        mean0 = F.coalesce(F.try_divide(F.col(f"_s0_{c}"), n0), F.lit(0.0))
        n = n0 + n1
        gap = here - mean0
        spread0 = F.greatest(F.col(f"_q0_{c}") - n0 * mean0 * mean0, F.lit(0.0))
        spread = spread0 + F.coalesce(F.col(f"_v1_{c}"), F.lit(0.0)) * n1
        spread = spread + F.coalesce(F.try_divide(gap * gap * n0 * n1, n), F.lit(0.0))
        mean = F.col(f"_c_{c}") + mean0 + F.coalesce(F.try_divide(gap * n1, n), F.lit(0.0))
        out = out.withColumns({f"{c}_mean": mean, f"{c}_std": F.sqrt(F.try_divide(spread, n))})
        scale = F.when(F.col(f"{c}_std") > 0, F.col(f"{c}_std")).otherwise(F.lit(1.0))
        out = out.withColumn(f"{c}_scaled", (F.col(c) - F.col(f"{c}_mean")) / scale)
    return out.drop(*local, *merged, *[f"_c_{c}" for c in columns])
