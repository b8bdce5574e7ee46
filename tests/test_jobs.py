"""The batch jobs end to end over stored tables."""

import datetime as dt
import os

import numpy as np
import pytest
from helpers import ticks_frame, walk
from pyspark.sql import functions as F

from pricetide import schemas
from pricetide.operators.series import Layout, tail_rows
from pricetide.plans import evaluation as J
from pricetide.plans.statistics import load_table, statistics
from pricetide.session import scratch_path, shared_folder
from pricetide.sources import tables as W
from pricetide.sources import versions as V

TARGETS = Layout(order=("target",))


def feed(spark, rows):
    return spark.createDataFrame(rows, "symbol string, epoch_ms long, last double, open double, base_volume double")


def test_ticks_are_taken_once(spark):
    path, copy = scratch_path(spark, "ticks"), scratch_path(spark, "unique")
    base = 1704067200000
    J.take_ticks(feed(spark, [("a", base, 1.0, 1.0, 1.0), ("a", base, 2.0, 1.0, 1.0)]), path)
    J.take_ticks(feed(spark, [("a", base, 3.0, 1.0, 1.0), ("a", base + 60000, 4.0, 1.0, 1.0), ("b", base, 5.0, 1.0, 1.0)]), path)
    got = spark.read.parquet(path)
    assert sorted((r.symbol, r.price) for r in got.collect()) == [("a", 1.0), ("a", 4.0), ("b", 5.0)]
    doubled = got.unionByName(got.withColumn("price", F.col("price") + 10)).drop("day")
    J.rewrite_unique(doubled, copy, ("price",))
    assert sorted(r.price for r in V.read_version(spark, copy, got.schema).collect()) == [1.0, 4.0, 5.0]


def test_evaluation_of_stored_forecasts(spark):
    pdf = walk(200)
    ticks = ticks_frame(spark, pdf)
    path = scratch_path(spark, "preds")
    assert J.load_forecasts(spark, path, 1).count() == 0
    made = ticks.select("symbol", (F.col("ts") + F.expr("interval 1 minute")).alias("target"), F.col("price").alias("baseline"))
    made = made.withColumn("y_hat", F.col("baseline") * 1.001)
    W.upsert(W.prepare_predictions(made, schemas.PREDICTIONS, 1), path, ["symbol", "target"], 1, ["y_hat"])
    out = J.evaluation(ticks, J.load_forecasts(spark, path, 1), TARGETS)
    figures = out["figures"].first()
    assert figures.n == 200 and figures.pending == 1
    err = pdf.price * 1.001 - pdf.price.shift(-1)
    assert np.isclose(figures.mae, err.abs().mean())
    tail = J.evaluation(ticks, J.load_forecasts(spark, path, 1), TARGETS, hours=1)
    assert tail["rows"].count() == 60
    assert np.isclose(out["latest"].first().last_price, pdf.price.iloc[-1])
    assert np.isclose(out["bands_real"].first().mu, pdf.price.iloc[1:].mean())


def test_posts_job_keeps_first_and_averages_the_whole_day(spark):
    path, means = scratch_path(spark, "posts"), scratch_path(spark, "means")
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "word string, score double")
    schema = "ativo string, data date, texto_original string, seq long"
    day = dt.date(2024, 1, 1)
    J.take_posts(spark.createDataFrame([("x", day, "good", 1), ("x", day, "good", 2)], schema), lexicon, path, means, 1, "seq")
    J.take_posts(spark.createDataFrame([("x", day, "good", 3), ("x", day, "bad", 4)], schema), lexicon, path, means, 2, "seq")
    assert spark.read.parquet(path).count() == 2
    log = W.read_log(spark, means, schemas.SENTIMENT)
    got = W.latest(log, ["ativo", "data"]).collect()
    assert log.count() == 2 and [(r.ativo, r.media_sentimento) for r in got] == [("x", 0.0)]


def test_statistics_page(spark):
    pdf = walk(400)
    table = ticks_frame(spark, pdf).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"), "symbol", "seq", "price", "return_pct")
    bad = table.limit(1).withColumn("Date", F.lit("never"))
    out = statistics(table.unionByName(bad), Layout(), "2024-01-01", "2024-01-01")
    target = pdf.return_pct.shift(-1)
    assert np.isclose(out["bands"].first().mu, pdf.price.mean())
    assert out["histogram"].agg(F.sum("n")).first()[0] == 399
    classes = {r.classe: r.n for r in out["classes"].collect()}
    assert classes[1] == (target > 0).sum()
    assert {r.a for r in out["correlations"].collect()} == {"price", "return_pct", "seq"}
    assert out["normal_curve"].count() == 200 and str(out["bounds"].first().first_date) == "2024-01-01"
    assert load_table(table, Layout()).count() == 400


def test_jobs_leave_their_outputs_alone(spark):
    path, log, compacted = (scratch_path(spark, n) for n in ("ticks", "log", "compacted"))
    before = set(os.listdir(shared_folder(spark)))
    base = 1704067200000
    J.take_ticks(feed(spark, [("a", base, 1.0, 1.0, 1.0)]), path)
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2023, 1, 1), 2.0)], "d date, close double")
    W.write_history(days, path + "-history", "d")
    with pytest.raises(W.DuplicateKeys):
        W.write_history(days.union(days), path + "-never", "d")
    for version, mean in ((1, 0.5), (2, 0.75)):
        rows = spark.createDataFrame([("x", dt.date(2024, 1, 1), mean), ("y", dt.date(2024, 1, version), mean)], schemas.SENTIMENT)
        W.upsert(rows, log, ["ativo", "data"], version, ["media_sentimento"])
    W.compact(spark, log, schemas.SENTIMENT, ["ativo", "data"], compacted)
    keys = ["ativo", "data"]
    rows = lambda p: sorted((r.ativo, r.data, r.media_sentimento) for r in W.latest(W.read_log(spark, p, schemas.SENTIMENT), keys).collect())
    assert rows(compacted) == rows(log) and W.read_log(spark, compacted, schemas.SENTIMENT).count() == 3
    assert W.read_log(spark, log, schemas.SENTIMENT).count() == 4
    made = set(os.listdir(shared_folder(spark))) - before
    assert made == {os.path.basename(p) for p in (path, path + "-history", path + "-never", log, compacted)}
    assert V.versions(spark, path + "-never") == [] and not os.listdir(path + "-never/data")


def test_newest_rows_prune_the_scan(spark):
    path = scratch_path(spark, "days")
    ticks = ticks_frame(spark, walk(6000)).withColumn("day", F.to_date("ts"))
    ticks.write.partitionBy("day").parquet(path)
    newest = tail_rows(spark.read.parquet(path), Layout(), 50)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan
    assert newest.count() == 50 and newest.agg(F.min("ts")).first()[0] == ticks.orderBy(F.desc("ts")).limit(50).agg(F.min("ts")).first()[0]
    assert tail_rows(ticks.where("false"), Layout(), 5).count() == 0
