"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each time is the median of BENCH_RUNS runs after one warm-up run. Results go to Spark's noop sink, so
a run computes every row and column and transfers none to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import REGISTRY
from pricetide.session import get_session

HEADLINE = (
    "q_clean_ticks",
    "q_minute_bars",
    "q_features_1m",
    "q_features_h30",
    "q_rsi",
    "q_obv",
    "q_eval_join",
    "q_kpis",
    "q_heatmap",
    "q_ewm_weights",
    "q_delayed_label",
    "q_backtest_curve",
    "q_daily_features",
    "q_histogram",
    "q_sentiment_daily",
    "q_insert_ignore",
    "q_stream_bars",
    "q_online_forecast",
    "q_walkforward",
)
# Minutes of learning per run: timed once, without a warm-up of its own.
LONG = ("q_walkforward",)


def run(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session("bench", cores)
    times = {}
    for name in HEADLINE:
        if name in LONG:
            times[name] = round(run(spark, name, sf_dir), 3)
            continue
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
