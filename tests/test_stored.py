"""Tables replaced by version, tables in order, sums that grow, the daily job over stored tables."""

import datetime as dt
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ticks_frame, walk

from pricetide import schemas
from pricetide.operators import evaluate as E
from pricetide.operators.bars import bars
from pricetide.operators.series import Layout, dense_index
from pricetide.plans import daily as D
from pricetide.plans import incremental as N
from pricetide.plans.features import ONE_MINUTE, feature_matrix
from pricetide.session import scratch_path
from pricetide.sources import aggregates as G
from pricetide.sources import clustered as K
from pricetide.sources import ordered as O
from pricetide.sources import tables as W
from pricetide.sources import versions as V

NUMBERS = "k long, v string"


def numbers(spark, n, v):
    return spark.range(n).select(F.col("id").alias("k"), F.lit(v).alias("v"))


def values(df):
    return {r.v for r in df.collect()}


def test_readers_keep_their_version(spark):
    path = scratch_path(spark, "versions")
    schema = numbers(spark, 1, "x").schema
    assert V.read_version(spark, path, schema).count() == 0 and V.versions(spark, path) == []
    assert V.replace_table(numbers(spark, 5, "a"), path, unique=["k"]) == 1
    old = V.read_version(spark, path, schema)
    # Made from the table itself.
    assert V.replace_table(old.where("k > 1").withColumn("v", F.lit("b")), path, unique=["k"]) == 2
    assert (old.count(), values(old)) == (5, {"a"})
    now = V.read_version(spark, path, schema)
    assert (now.count(), values(now)) == (3, {"b"})
    assert V.read_version(spark, path, schema, 1).count() == 5
    assert V.drop_versions(spark, path, keep=1) == [1] and V.versions(spark, path) == [2]
    assert values(V.read_version(spark, path, schema)) == {"b"}


def test_a_broken_write_is_never_seen(spark):
    path = scratch_path(spark, "broken")
    V.replace_table(numbers(spark, 4, "a"), path)

    def half_way(df, place):
        df.limit(1).write.parquet(place)
        raise OSError("the writer is gone")

    with pytest.raises(OSError):
        V.replace_table(numbers(spark, 4, "b"), path, writer=half_way)
    schema = numbers(spark, 1, "x").schema
    assert values(V.read_version(spark, path, schema)) == {"a"} and V.versions(spark, path) == [1]
    # Its number is passed over, and cleaned away with what is older.
    assert V.replace_table(numbers(spark, 4, "c"), path) == 3
    assert values(V.read_version(spark, path, schema)) == {"c"}
    assert V.drop_versions(spark, path, keep=1) == [1, 2] and os.listdir(f"{path}/data") == ["v=3"]


def test_of_two_writers_one_publishes(spark):
    path = scratch_path(spark, "race")

    def slow(df, place):
        df.write.parquet(place)
        V.publish(spark, path, 1)

    with pytest.raises(V.LostRace):
        V.replace_table(numbers(spark, 4, "late"), path, writer=slow)
    with pytest.raises(V.DuplicateKeys):
        V.replace_table(numbers(spark, 2, "x").union(numbers(spark, 2, "y")), path, unique=["k"])
    assert V.versions(spark, path) == [1]


def post_rows(spark, days=9, each=40):
    rows = [("x" if i // days % 3 else "y", dt.date(2024, 1, 1 + i % days), f"text {i * 7 % 100:03d} {i}", float(i)) for i in range(days * each)]
    return spark.createDataFrame(rows, schemas.POSTS)


def test_files_follow_the_order_and_ranges_are_pruned(spark):
    path = scratch_path(spark, "ordered")
    O.write_ordered(post_rows(spark), path, ["ativo", "texto_original"], by=["data"], tasks=30)
    files = sorted(glob.glob(f"{path}/data=2024-01-05/*.parquet"))
    assert len(files) > 1
    read = [[(r.ativo, r.texto_original) for r in spark.read.parquet(f).collect()] for f in files]
    assert sum(read, []) == sorted(sum(read, [])) and len(sum(read, [])) == 40
    got = O.posts_between(spark, path, schemas.POSTS, "2024-01-03", "2024-01-04", asset="x")
    rows = [(r.data, r.ativo, r.texto_original) for r in got.collect()]
    assert rows == sorted(rows, key=lambda r: (-r[0].toordinal(), r[1], r[2])) and {r[1] for r in rows} == {"x"}
    assert {r[0].day for r in rows} == {3, 4}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(data" in plan and "EqualTo(ativo,x)" in plan
    scanned = O.scan_range(spark.read.parquet(path), "data", "2024-01-03", "2024-01-04")
    assert {os.path.basename(os.path.dirname(r.f)) for r in scanned.select(F.input_file_name().alias("f")).distinct().collect()} == {"data=2024-01-03", "data=2024-01-04"}
    assert O.posts_between(spark, scratch_path(spark, "none"), schemas.POSTS, "2024-01-03", "2024-01-04").count() == 0


def test_order_without_directories(spark):
    path = scratch_path(spark, "sorted")
    O.write_ordered(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")), path, [F.desc("k")], tasks=4)
    files = sorted(glob.glob(f"{path}/*.parquet"))
    assert len(files) == 4
    assert [r.k for f in files for r in spark.read.parquet(f).collect()] == list(range(999, -1, -1))


def test_means_scan_takes_the_newest(spark):
    path = scratch_path(spark, "means")
    rows = [("x", dt.date(2024, 1, d), float(d)) for d in range(1, 9)]
    W.upsert(spark.createDataFrame(rows, schemas.SENTIMENT), path, ["ativo", "data"], 1, ["media_sentimento"])
    W.upsert(spark.createDataFrame([("x", dt.date(2024, 1, 4), 0.5), ("y", dt.date(2024, 1, 4), 9.0)], schemas.SENTIMENT), path, ["ativo", "data"], 2, ["media_sentimento"])
    got = O.means_between(spark, path, schemas.SENTIMENT, "2024-01-03", "2024-01-05")
    assert [(r.data.day, r.ativo, r.media_sentimento) for r in got.collect()] == [(3, "x", 3.0), (4, "x", 0.5), (4, "y", 9.0), (5, "x", 5.0)]
    assert O.means_between(spark, path, schemas.SENTIMENT, "2024-01-03", "2024-01-05", asset="y").count() == 1
    assert "GreaterThanOrEqual(data" in got._jdf.queryExecution().executedPlan().toString()


def test_sums_of_batches_add_up(spark):
    path, out = scratch_path(spark, "sums"), scratch_path(spark, "compacted")
    keys = spark.createDataFrame([], "k string").schema
    batches = [[("a", 1.0), ("a", 2.0), ("b", None)], [("a", 6.0), ("c", -1.0)]]
    for version, rows in enumerate(batches):
        for _ in range(2):
            # The second time is a repetition.
            G.add_batch(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], path, version)
    told = lambda p: sorted((r.k, r.m, r.n) for r in G.stored_means(spark, p, keys, "m").collect())
    assert told(path) == [("a", 3.0, 3), ("c", -1.0, 1)]
    G.compact_sums(spark, path, keys, out)
    assert told(out) == told(path) and spark.read.parquet(out).count() == 2
    assert told(scratch_path(spark, "none")) == []


def test_daily_job_over_stored_tables(spark):
    history, calendar, means, out = (scratch_path(spark, n) for n in ("history", "calendar", "means", "features"))
    days = [dt.date(2023, 11, 1) + dt.timedelta(days=i) for i in range(80)]
    rows = [(s, d, 1.0, 3.0, 0.5, 2.0 + (i * 7 % 11) / 10, None, 5.0 + i % 4) for s in ("x", "y") for i, d in enumerate(days)]
    V.replace_table(spark.createDataFrame(rows, schemas.DAILY).withColumn("year", F.year("d")), history, unique=["symbol", "d"], by=["year"])
    assert D.daily_job(spark, history, calendar, means, out) == 1
    assert D.read_features(spark, out).count() == 2 * (80 - 33)
    spark.createDataFrame([("x", days[50], "halving"), ("y", days[50], "fork")], schemas.CALENDAR).write.parquet(calendar)
    W.upsert(spark.createDataFrame([("x", days[60], 0.25)], schemas.SENTIMENT), means, ["ativo", "data"], 1, ["media_sentimento"])
    assert D.daily_job(spark, history, calendar, means, out, asset="x") == 2
    got = {r.d: r for r in D.read_features(spark, out).collect()}
    assert len(got) == 47 and {r.symbol for r in got.values()} == {"x"}
    assert [d for d, r in got.items() if r.evento_halving] == [days[50]] and not any(r.evento_fork for r in got.values())
    assert [d for d, r in got.items() if r.media_sentimento] == [days[60]]
    assert D.read_features(spark, out, 1).where("evento_halving = 1").count() == 0


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_clustered_ticks_are_numbered_and_joined_where_they_are_read(spark):
    layout = Layout(cell_seconds=3600)
    ticks = ticks_frame(spark, walk(900)).unionByName(ticks_frame(spark, walk(300, "b", seed=5)))
    path = scratch_path(spark, "clustered")
    stored = K.write_clustered(ticks, "ticks_by_cell", path, layout, buckets=4)
    plain = scratch_path(spark, "plain")
    ticks.write.parquet(plain)
    ticks = spark.read.parquet(plain)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(K.clustered_bars(stored)) == 0 and exchanges(bars(ticks)) == 1
        assert exchanges(dense_index(stored, layout)) < exchanges(dense_index(ticks, layout))
        assert exchanges(feature_matrix(stored, ONE_MINUTE, layout, staged=False)) < exchanges(feature_matrix(ticks, ONE_MINUTE, layout, staged=False))
        minute = K.write_clustered(bars(ticks), "bars_by_cell", scratch_path(spark, "bars"), Layout(order=("minute",), cell_seconds=3600), 4)
        preds = ticks.select("symbol", F.date_trunc("minute", "ts").alias("target"), F.col("price").alias("y_hat"), F.lit(100.0).alias("baseline")).dropDuplicates(["symbol", "target"])
        asked = K.write_clustered(preds, "preds_by_cell", scratch_path(spark, "preds"), Layout(order=("target",), cell_seconds=3600), 4)
        joined = K.evaluated_clustered(asked, minute)
        assert exchanges(joined) == 0
        told = lambda df: sorted((r.symbol, r.target, r.price_real) for r in df.collect())
        assert told(joined) == told(E.evaluated(asked.drop("_cell"), bars(ticks)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    key = lambda df: sorted(map(tuple, df.select("symbol", "seq", "gi").collect()))
    assert key(dense_index(stored, layout)) == key(dense_index(ticks, layout))
    # Another session knows the files alone.
    again = K.attach(spark, "ticks_attached", path, stored.schema, layout, 4)
    assert exchanges(K.clustered_bars(again)) == 0 and again.count() == 1200
    for t in ("ticks_by_cell", "bars_by_cell", "preds_by_cell", "ticks_attached"):
        spark.sql(f"DROP TABLE {t}")


@pytest.mark.parametrize("steps", [[40, 41, 900, 1000], [1000], [700, 1000]])
def test_indicators_in_steps_equal_those_made_at_once(spark, steps):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(1000)]
    rows = [(s, d, 1.0, 3.0, 0.5, 2.0 + (i * i * 7 % 113) / 50, None, 5.0 + i % 4) for s, n in (("x", 1000), ("y", 35)) for i, d in enumerate(days[-n:])]
    history = spark.createDataFrame(rows, schemas.DAILY)
    path = scratch_path(spark, "indicators")
    for run, n in enumerate(steps):
        for _ in range(2 if run == 1 else 1):
            # The second step comes twice.
            N.refresh(spark, history.where(F.col("d") <= days[n - 1]), path, run)
    got = N.indicators(spark, path).toPandas().sort_values(["symbol", "d"]).reset_index(drop=True)
    want = D.daily_indicators(history.select("symbol", *D.REQUIRED)).toPandas().sort_values(["symbol", "d"]).reset_index(drop=True)
    assert got.gi.tolist() == want.gi.tolist() and got.d.tolist() == want.d.tolist()
    for c in D.INDICATORS:
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True, rtol=1e-9, atol=1e-12), c
