"""Feature matrix of one long series: rows per second.

usage: python tools/long_series.py [rows] [cores]
The series is a deterministic walk made by Spark: one symbol, a row a minute.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from pricetide.plans.features import feature_matrix, layout_for
from pricetide.session import get_session, scratch_path


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000
    cores = sys.argv[2] if len(sys.argv) > 2 else "8"
    spark = get_session("long", cores, shuffle_partitions=64)
    path = scratch_path(spark, "long")
    i = F.col("id")
    spark.range(0, rows, 1, 64).select(
        F.lit("a").alias("symbol"),
        F.timestamp_seconds(i * 60).alias("ts"),
        i.alias("seq"),
        (100 + 10 * F.sin(i / 5000.0) + F.rand(1)).alias("price"),
        F.lit(100.0).alias("open"),
        F.floor(F.rand(2) * 50).cast("double").alias("volume"),
        F.lit(0.0).alias("return_pct"),
    ).write.parquet(path)
    ticks = spark.read.parquet(path)
    for staged in (False, True):
        begin = time.time()
        feature_matrix(ticks, layout=layout_for(60), staged=staged).write.format("noop").mode("overwrite").save()
        took = time.time() - begin
        print(f"rows {rows} cores {cores} staged {staged}: {took:.1f} s, {rows / took:,.0f} rows/s", flush=True)


if __name__ == "__main__":
    main()
