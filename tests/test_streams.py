"""Joins of streams, late ticks, posts as a stream."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pricetide.operators import evaluate as E
from pricetide.operators.bars import bars
from pricetide.session import scratch_path
from pricetide.sources import tables as W
from pricetide.sources.aggregates import stored_means
from pricetide.streaming import ingest as I
from pricetide.streaming import joins as J
from pricetide.streaming import late as A
from pricetide.streaming import posts as O

TICKS = "symbol string, ts timestamp, seq long, price double, volume double"
PREDS = "symbol string, target timestamp, y_hat double, baseline double"
BARS = "symbol string, minute timestamp, price double"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute, seconds=second)


def landed(spark, schema, *files):
    """A stream of files, one a batch, in this order."""
    path = scratch_path(spark, "landed")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return I.tick_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1), path


def worked_off(spark, stream, keys):
    out = scratch_path(spark, "out")
    I.start(stream, I.without_clock(I.upsert_sink(out, keys, keys)), scratch_path(spark, "state"), every=None).awaitTermination()
    return spark.read.parquet(out)


FORECASTS = [[("a", at(1), 11.0, 10.0), ("a", at(2), 9.0, 10.0), ("b", at(1), 5.0, 5.0)], [("a", at(30), 3.0, 4.0), ("a", at(90), 1.0, 1.0)]]
PRICES = [[("a", at(0), 10.0), ("a", at(1), 12.0)], [("a", at(30), 4.5), ("b", at(2), 1.0), ("b", at(33), 1.0)]]
CLOCKS = [(I.CLOCK, at(300), None, None)], [(I.CLOCK, at(300), None)]


def plain(spark, how):
    preds = spark.createDataFrame(sum(FORECASTS, []), PREDS)
    rows = E.evaluated(preds, spark.createDataFrame(sum(PRICES, []), BARS))
    return rows if how == "left" else rows.where("price_real is not null")


def told(df):
    return sorted((r.symbol, r.target, r.price_real, r.erro, r.acerto_dir, r.melhor_que_base) for r in df.collect())


def test_scored_as_soon_as_both_are_there(spark):
    preds, prices = landed(spark, PREDS, *FORECASTS)[0], landed(spark, BARS, *PRICES)[0]
    got = worked_off(spark, J.score_stream(preds, prices), ["symbol", "target"])
    assert told(got) == told(plain(spark, "inner")) and got.count() == 2


@pytest.mark.parametrize("clock", [False, True])
def test_pending_forecasts_come_out_when_the_watermark_passes(spark, clock):
    ends = CLOCKS if clock else ([], [])
    preds = landed(spark, PREDS, *FORECASTS, *([ends[0]] if clock else []))[0]
    prices = landed(spark, BARS, *PRICES, *([ends[1]] if clock else []))[0]
    got = worked_off(spark, J.settled_stream(preds, prices), ["symbol", "target"])
    want = told(plain(spark, "left"))
    # Without later rows nothing says that the forecasts for minute 30 and later won't be met.
    assert told(got) == (want if clock else [r for r in want if r[1] <= at(23) or r[2] is not None])
    assert got.count() == len(got.select("symbol", "target").distinct().collect())


def test_join_state_is_bounded(spark):
    """What both watermarks have passed is forgotten."""
    files = [[("a", at(60 * k + m), 1.0 + m) for m in range(60)] for k in range(5)]
    prices = landed(spark, BARS, *files)[0]
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    stream = J.label_stream(prices)
    query = I.start(stream, I.upsert_sink(out, ["symbol", "minute"], ["minute"]), state, every=None)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    # 300 bars on each side; the delay is 10 minutes, the horizon 30, and an hour comes at once.
    assert max(held) <= 2 * 60 + 2 * 60 + 80 and held[-1] <= 100
    want = E.delayed_labels(spark.createDataFrame(sum(files, []), BARS))
    rows = lambda df: sorted((r.minute, r.label_at, r.y_label) for r in df.collect())
    assert rows(spark.read.parquet(out)) == rows(want) and want.count() == 270


def test_late_ticks_are_kept_and_their_bars_rebuilt(spark):
    files = [
        [("a", at(0, 1), 1, 1.0, 1.0), ("a", at(0, 5), 2, 2.0, None), ("b", at(1), 3, 5.0, 2.0), ("c", at(0), 9, 1.0, None)],
        [("a", at(30), 4, 3.0, 1.0), ("a", at(30), 44, 3.25, 1.0), ("a", at(20, 59), 40, 3.5, 1.0)],
        [("a", at(0, 9), 5, 9.0, 1.0), ("a", at(40), 6, 4.0, 4.0), ("d", at(5), 7, 7.0, 7.0)],
        [(I.CLOCK, at(200), None, None, None)],
    ]
    stream, path = landed(spark, TICKS, *files)
    out, side, state = (scratch_path(spark, n) for n in ("bars", "late", "state"))
    sink = I.without_clock(A.late_sink(out, side))

    def run():
        I.start(A.bars_and_late(stream), sink, state, every=None).awaitTermination()
        return sorted((r.symbol, r.minute, r.price, r.volume, r.n) for r in A.stored_bars(spark, out).collect())

    first = run()
    assert ("a", at(0), 2.0, 1.0, 2) in first and ("a", at(30), 3.25, 2.0, 2) in first and ("c", at(0), 1.0, None, 1) in first
    late = spark.read.parquet(side)
    assert sorted((r.symbol, r.minute, r.ts, r.seq) for r in late.collect()) == [("a", at(0), at(0, 9), 5), ("d", at(5), at(5), 7)]
    schema = spark.createDataFrame([], TICKS).schema
    assert A.rebuild(spark, path, schema, out, side, 1) == 2
    want = bars(spark.createDataFrame(sum(files[:-1], []), TICKS), "minute")
    whole = sorted((r.symbol, r.minute, r.price, r.volume, r.n) for r in want.collect())
    assert run() == whole
    # A restart finds nothing new, a second rebuild changes nothing, and just the touched bars were written.
    A.rebuild(spark, path, schema, out, side, 1)
    assert run() == whole
    assert spark.read.parquet(out).where(F.col("version") >= A.REBUILT).count() == 2
    newest = late.agg(F.max("version")).first()[0]
    assert A.rebuild(spark, path, schema, out, side, 2, since=newest) == 0


def json_lines(spark, path, rows):
    spark.createDataFrame(rows, O.FEED).coalesce(1).write.mode("append").json(path)


def test_posts_are_stored_once(spark):
    feed, out = scratch_path(spark, "feed"), scratch_path(spark, "stored")
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "word string, score double")
    day = 86400
    json_lines(spark, feed, [("x", " good ", 10, 1), ("x", "good", 20, 2), ("x", "bad", 30, 3), ("x", " ", 30, 4), ("y", "good\nbad bad", day, 5)])
    spark.createDataFrame([("{broken",), ('["no", "record"]',)], "value string").coalesce(1).write.mode("append").text(feed)
    json_lines(spark, feed, [("x", "good", 40, 6), ("x", "good", day, 7), ("x", "bad good", 5, 8)])
    state = scratch_path(spark, "state")

    def run(checkpoint, feed_name="f"):
        I.start(O.post_stream(spark, feed, 1), O.post_sink(out, lexicon, feed_name), checkpoint, every=None).awaitTermination()
        means = {(r.ativo, r.data.day): (r.media_sentimento, r.n) for r in stored_means(spark, f"{out}/means", O.DAY_KEYS, "media_sentimento").collect()}
        return sorted((r.seq, r.ativo, r.texto_original, r.sentimento) for r in O.stored_posts(spark, out).collect()), means

    want = [(1, "x", "good", 1.0), (3, "x", "bad", -1.0), (5, "y", "good\nbad bad", -1 / 3), (7, "x", "good", 1.0), (8, "x", "bad good", 0.0)]
    posts, means = run(state)
    assert posts == want
    assert means == {("x", 1): (0.0, 3), ("y", 2): (pytest.approx(-1 / 3), 1), ("x", 2): (1.0, 1)}
    assert {r.line for r in O.malformed_lines(spark, out).collect()} == {"{broken", '["no", "record"]'}
    # The same batches again, from the checkpoint and without it; then the feed under another name.
    assert run(state) == (posts, means) and run(scratch_path(spark, "state")) == (posts, means)
    assert run(scratch_path(spark, "state"), "g") == (posts, means)


def test_a_batch_that_broke_off_is_written_again(spark, monkeypatch):
    feed, out = scratch_path(spark, "feed"), scratch_path(spark, "stored")
    lexicon = spark.createDataFrame([("good", 1.0)], "word string, score double")
    json_lines(spark, feed, [("x", "good", 10, 1), ("x", "other", 10, 2)])
    batch = spark.read.schema(O.post_stream(spark, feed).schema).json(feed).withColumn(O.MALFORMED, F.lit(None).cast("string"))
    sink = O.post_sink(out, lexicon, "f")
    with monkeypatch.context() as m:
        m.setattr(O, "add_batch", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            sink(batch, 0)
    assert O.stored_posts(spark, out).count() == 2 and not os.path.exists(f"{out}/ledger/f-0")
    sink(batch, 0)
    sink(batch, 0)
    assert O.stored_posts(spark, out).count() == 2
    assert [r.n for r in stored_means(spark, f"{out}/means", O.DAY_KEYS, "m").collect()] == [2]


def test_landing_keeps_the_order(spark):
    path = scratch_path(spark, "landed")
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k"), F.lit("x").alias("symbol"))
    I.land(df, path, "k", 4)
    I.land_clock(spark, path, df.schema, "k", 1000)
    files = sorted((os.path.getmtime(f"{path}/{f}"), f) for f in os.listdir(path) if f.startswith("part"))
    read = [sorted(r.k for r in spark.read.parquet(f"{path}/{f}").collect()) for _, f in files]
    assert sum(read, []) == [*range(100), 1000]
    I.land(df.where("false"), path, "k", 4)
    assert spark.read.parquet(path).count() == 101
    assert W.latest(spark.read.parquet(path), ["k"], ["symbol"]).count() == 101
