"""Cleaning, keyed writes, metadata, posts, daily features, statistics."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from helpers import ticks_frame, walk
from pyspark.sql import functions as F

from pricetide import schemas
from pricetide.functions import scalars as S
from pricetide.operators import sentiment as P
from pricetide.operators import stats as X
from pricetide.operators.series import Layout
from pricetide.plans.daily import INDICATORS, LAYOUT, daily_features, daily_indicators
from pricetide.plans.forecast import GRID, published
from pricetide.session import scratch_path
from pricetide.sources import readers as R
from pricetide.sources import tables as W
from pricetide.sources import versions as V


def test_cleaning_keeps_the_last_row_then_drops_bad_prices(spark):
    rows = [
        ("a", "2024-01-01 00:00:00", 1, "5", "1"),
        ("a", "2024-01-01 00:00:00", 2, "abc", "1"),
        ("a", "NaT", 3, "6", "1"),
        ("a", "2024-01-01 00:01:00", 4, "7", "x"),
        ("a", None, 5, "7", "1"),
        ("b", "2024-01-01 00:00:00", 1, "NaN", "1"),
    ]
    raw = spark.createDataFrame(rows, "symbol string, ts string, seq long, price string, volume string")
    got = R.clean_ticks(raw).collect()
    assert [(r.symbol, r.seq, r.price, r.volume) for r in got] == [("a", 4, 7.0, None)]
    assert R.purge_bad_keys(raw, "ts").count() == 4


def test_survivor_filter_runs_before_the_shuffle(spark):
    copies = (F.col("id") % 1).alias("ts")
    df = spark.range(1000).select(F.col("id").alias("seq"), copies, (F.col("id") % 1).alias("symbol"))
    kept = R.keep_last(df.repartition(4), ["symbol", "ts"], ["seq"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert [r.seq for r in kept.collect()] == [999]


def test_column_names_and_requirements(spark):
    df = spark.createDataFrame([(1.0, "x", 2)], "Price double, Datetime string, `Return_%` int")
    out = R.normalize_columns(df)
    assert out.columns == ["price", "ts", "return_pct"]
    assert R.numeric_columns(out, exclude=["price"]) == ["return_pct"]
    with pytest.raises(R.MissingColumns):
        R.require_columns(out, ["volume"])


def test_missing_table_is_empty_and_filters_reach_the_scan(spark):
    path = scratch_path(spark, "cal")
    assert R.read_if_exists(spark, path, schemas.CALENDAR).count() == 0
    rows = [("abc", dt.date(2024, 1, 1), "halving"), ("eth", dt.date(2024, 1, 2), "fork")]
    spark.createDataFrame(rows, schemas.CALENDAR).write.parquet(path)
    got = R.read_if_exists(spark, path, schemas.CALENDAR, F.col("ativo") == "abc")
    assert got.count() == 1
    assert "EqualTo(ativo,abc)" in got._jdf.queryExecution().executedPlan().toString()


def test_day_filter_is_inclusive_and_pushed_down(spark):
    path = scratch_path(spark, "days")
    ticks_frame(spark, walk(4000)).write.parquet(path)
    got = R.between_days(spark.read.parquet(path), "ts", "2024-01-02", "2024-01-02")
    assert got.count() == 1440
    assert "GreaterThanOrEqual(ts" in got._jdf.queryExecution().executedPlan().toString()


def test_history_gate_is_per_symbol(spark):
    df = ticks_frame(spark, pd.concat([walk(30, "a"), walk(5, "b")]))
    assert {r.symbol for r in R.with_history(df, "symbol", 10).collect()} == {"a"}


def test_feed_projection(spark):
    feed = spark.createDataFrame(
        [("ABC/USD", 1704110400000, 110.0, 100.0, 5.0), ("ABC/USD", 1704110460000, 110.0, 0.0, 5.0)],
        "symbol string, epoch_ms long, last double, open double, base_volume double",
    )
    got = R.project_ticks(feed).withColumn("local", S.local_time("ts")).withColumn("asset", S.asset_of("symbol"))
    first, second = got.collect()
    assert first.return_pct == pytest.approx(10.0) and second.return_pct == 0.0
    assert str(got.select(F.date_format("local", "HH:mm")).first()[0]) == "09:00" and first.asset == "abc"


def test_scalar_rules(spark):
    df = spark.createDataFrame([(None, 1.0), (9.0, 0.0), (-9.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "x double, y double")
    got = df.select(
        S.clip("x", -1, 1).alias("c"),
        S.change("x", "y").alias("r"),
        S.bounded_change("x", "y", 0.3).alias("b"),
        S.finite_or(S.change("x", "y"), 7).alias("f"),
        S.money("x").alias("m"),
    ).collect()
    assert [r.c for r in got] == [None, 1, -1, 0, 1]
    assert [r.r for r in got] == [None, float("inf"), float("-inf"), None, 0.5]
    assert [r.b for r in got] == [None, 0.3, -0.3, None, 0.3]
    assert [r.f for r in got] == [7, 7, 7, 7, 0.5]
    assert [r.m for r in got] == ["—", "9.00", "-9.00", "0.00", "3.00"]


def predictions(spark, y):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 1, 30), y), ("a", None, y), ("a", dt.datetime(2024, 1, 1, 0, 2), y)]
    df = spark.createDataFrame(rows, "symbol string, target timestamp, y_hat double")
    return W.prepare_predictions(df, schemas.PREDICTIONS, 1)


def test_upsert_is_idempotent_and_newest_wins(spark):
    path = scratch_path(spark, "preds")
    for version, y in ((1, 1.0), (2, 2.0), (2, 3.0)):
        W.upsert(predictions(spark, y), path, ["symbol", "target"], version, ["created_at"])
    log = W.read_log(spark, path, schemas.PREDICTIONS)
    got = W.latest(log, ["symbol", "target"])
    assert log.count() == 4
    assert {(r.target.minute, r.y_hat, r.horizon_min) for r in got.collect()} == {(1, 3.0, 1), (2, 3.0, 1)}


def test_old_files_without_members_still_read(spark):
    path = scratch_path(spark, "evolve")
    old = W.conform(predictions(spark, 1.0), schemas.PREDICTIONS_V1)
    W.write_version(old, path, 1)
    W.write_version(predictions(spark, 2.0).withColumn("w_pa", F.lit(0.5)), path, 2)
    log = W.read_log(spark, path, schemas.PREDICTIONS)
    assert log.where("version = 1 and w_pa is null").count() == 2
    assert log.where("version = 2 and w_pa = 0.5").count() == 2


def test_insert_if_absent_and_duplicates(spark):
    target = spark.createDataFrame([(1, "x")], "k int, v string")
    batch = spark.createDataFrame([(1, "y", 1), (2, "b", 3), (2, "a", 2), (3, "c", 4)], "k int, v string, o int")
    added = W.insert_if_absent(target, batch, ["k"], ["o"])
    assert {(r.k, r.v) for r in added.collect()} == {(2, "a"), (3, "c")}
    assert [(r.k, r.first_row, r.surplus) for r in W.duplicates(batch, ["k"], "o").collect()] == [(2, 2, 1)]


def test_replace_checks_its_key(spark):
    path = scratch_path(spark, "hist")
    one = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2023, 1, 1), 2.0)], "d date, close double")
    assert W.write_history(one, path, "d") == 1
    schema = one.withColumn("year", F.lit(1)).schema
    assert V.read_version(spark, path, schema, condition=F.col("year") == 2023).count() == 1
    with pytest.raises(W.DuplicateKeys):
        W.write_history(one.unionByName(one), path, "d")
    W.write_history(one.where("close = 1"), path, "d")
    assert V.read_version(spark, path, schema).count() == 1


def test_metadata(spark):
    rows = [("s", '{"hps": {"pa": {"C": 0.5}}}', 1), ("s", '{"hps": {"pa": {"C": 0.75}}}', 2), ("t", "plain text", 1)]
    meta = spark.createDataFrame(rows, "key string, value string, u long").select(
        "key", "value", F.timestamp_seconds("u").alias("updated_at")
    )
    got = {r.key: r for r in W.meta_decoded(meta, schemas.STATE_JSON).collect()}
    assert got["s"].decoded.hps.pa.C == 0.75
    assert got["t"].text == "plain text" and (got["t"].decoded is None or got["t"].decoded.hps is None)
    row = W.meta_row(spark, "k", {"a": 1}).first()
    assert json.loads(row.value) == {"a": 1}
    winner = spark.createDataFrame([("a", 2, 0.1)], "symbol string, hp_id int, mae double")
    state = json.loads(published(winner).first().value)
    assert state["hps"] == GRID[2] and "tuned_at" in state


def test_export_headers(spark):
    row = "1.0 as price_real, 2.0 as y_hat, 1.0 as erro, 0.5 as erro_base, 1.0 as acerto_dir, 0.1 as y_hat_ret, 1.5 as baseline"
    df = spark.sql(f"select timestamp'2024-01-01' as target, {row}")
    path = scratch_path(spark, "export")
    W.export_metrics(df, path)
    back = spark.read.csv(f"{path}/csv", header=True)
    assert back.columns == list(W.EXPORT_COLUMNS.values()) and back.count() == 1
    assert spark.read.parquet(f"{path}/parquet").columns == back.columns


def test_posts_and_polarity(spark):
    feed = spark.createDataFrame(
        [("abc", " \tgood good bad\n", 0, 1), ("abc", "  \n", 0, 2), ("abc", "none here", 86400, 3)],
        "ativo string, title string, created_utc long, seq long",
    )
    other = spark.createDataFrame([("abc", "BAD", 4)], "ativo string, title string, seq long")
    posts = R.read_posts([feed, other])
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -0.5)], "word string, score double")
    got = {r.seq: r.sentimento for r in P.polarity(posts, lexicon, "texto_original", ["seq", "ativo", "data"]).collect()}
    assert got == {1: 0.5, 3: 0.0, 4: -0.5}
    assert {str(r.data) for r in posts.collect()} == {"1970-01-01", "1970-01-02"}


def test_flags_and_sentiment_do_not_multiply_rows(spark):
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    days = spark.createDataFrame([("x", first), ("x", second), ("y", first), ("y", second)], "symbol string, d date")
    events = [("x", dt.date(2024, 1, 1), "halving")] * 3 + [("x", dt.date(2024, 1, 1), "other")]
    flagged = P.with_event_flags(days, spark.createDataFrame(events, schemas.CALENDAR), "d", ["halving", "fork"])
    flags = [(r.evento_halving, r.evento_fork) for r in flagged.orderBy("symbol", "d").collect()]
    assert flags == [(1, 0), (0, 0), (0, 0), (0, 0)]
    means = spark.createDataFrame([("x", second, 0.25), ("y", second, 0.5), ("z", first, 1.0)], schemas.SENTIMENT)
    got = P.with_daily_sentiment(days, means, "d").orderBy("symbol", "d").collect()
    assert [r.media_sentimento for r in got] == [0.0, 0.25, 0.0, 0.5]


def daily_frame(n=120, seed=2):
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    out = pd.DataFrame({"symbol": "x", "d": pd.date_range("2020-01-01", periods=n).date})
    out["open"], out["high"], out["low"], out["close"] = close, close + 1, close - 1, close
    out["volume"] = rng.integers(1, 100, n).astype(float)
    return out


@pytest.mark.parametrize("cut", [LAYOUT, Layout(order=("d",), cell_seconds=86400 * 30, chunk_rows=16, sub_rows=32)])
def test_daily_indicators(spark, cut):
    pdf = daily_frame()
    got = daily_indicators(spark.createDataFrame(pdf), cut).toPandas().sort_values("d").reset_index(drop=True)
    c = pdf.close
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    line = ema(c, 12) - ema(c, 26)
    idx = np.arange(len(c))
    move = c.diff()
    up = move.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    down = (-move.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    want = {
        "return_pct": c.pct_change() * 100,
        "return_log": np.log(c / c.shift(1)),
        "sma_7": c.rolling(7).mean(),
        "ema_30": ema(c, 30).where(idx >= 29),
        "rsi_14": (100 - 100 / (1 + up / down)).where(idx >= 13),
        "macd": line.where(idx >= 25),
        "macd_s": ema(line, 9).where(idx >= 33),
        "bbu": c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0),
        "volatilidade_7d": c.rolling(7).std(),
    }
    for name, series in want.items():
        assert np.allclose(got[name].to_numpy(float), series.to_numpy(float), equal_nan=True, rtol=1e-9), name


def test_daily_features_are_complete_and_keep_empty_inputs(spark):
    pdf = daily_frame()
    df = spark.createDataFrame(pdf)
    out = daily_features(df, spark.createDataFrame([], schemas.CALENDAR), spark.createDataFrame([], schemas.SENTIMENT))
    got = out.toPandas()
    assert len(got) == len(pdf) - 33 and not got.isna().any().any()
    assert (got.evento_fork == 0).all() and (got.media_sentimento == 0).all()
    z = (pdf.volume - pdf.volume.mean()) / pdf.volume.std()
    assert np.allclose(got.sort_values("d").volume_norm, z.iloc[33:])
    assert set(INDICATORS) <= set(got.columns)
    same = df.withColumn("volume", F.lit(3.0))
    assert X.zscore(same, "volume", "z").where("z != 0").count() == 0


def test_statistics(spark):
    pdf = walk(300, missing=0.2)
    df = ticks_frame(spark, pdf)
    want = pdf[["open", "price", "return_pct", "volume"]].corr().round(2)
    got = X.correlations(df.select("price", "return_pct", "volume"))
    for r in got.collect():
        assert r.r == pytest.approx(want.loc[r.a, r.b], abs=0.0101)
    assert {(r.a, r.b) for r in got.collect()} >= {("price", "volume"), ("volume", "price"), ("price", "price")}

    bins = X.histogram(df, "price", bins=10, by=["symbol"]).toPandas().sort_values("bin")
    counts, edges = np.histogram(pdf.price, bins=10)
    assert bins.n.tolist() == counts.tolist() and np.allclose(bins.left_edge, edges[:-1])
    assert np.allclose(bins.density, np.histogram(pdf.price, bins=10, density=True)[0])
    whole = X.histogram(df, "price", bins=10).toPandas().sort_values("bin")
    assert whole.n.tolist() == counts.tolist()

    curve = X.normal_curve(df, "price", by=["symbol"]).toPandas().sort_values("i")
    mu, sd = pdf.price.mean(), pdf.price.std(ddof=0)
    x = np.linspace(pdf.price.min(), pdf.price.max(), 200)
    assert np.allclose(curve.pdf, np.exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * np.sqrt(2 * np.pi)))
    assert X.normal_curve(df.limit(5), "price").count() == 0
    flat = X.normal_curve(df.withColumn("price", F.lit(1.0)), "price").toPandas()
    assert (flat.pdf == 0).all()
    assert X.histogram(df.withColumn("price", F.lit(1.0)), "price").where("n = 300 and bin = 0").count() == 1


def test_next_row_target_and_classes(spark):
    df = ticks_frame(spark, walk(50)).select("symbol", "ts", "seq", F.col("return_pct").alias("ret"))
    out = X.with_targets(df, Layout()).toPandas().sort_values("seq")
    assert np.allclose(out.target_pct.iloc[:-1], out.ret.iloc[1:]) and np.isnan(out.target_pct.iloc[-1])
    assert pd.isna(out.target_bin.iloc[-1])
    zero = X.with_targets(df, Layout(), null_as_zero=True)
    counts = {r.classe: r.n for r in X.class_counts(zero).collect()}
    assert counts[0] + counts[1] == 50
    only_up = spark.createDataFrame([(1,)], "target_bin int")
    assert {r.classe: r.n for r in X.class_counts(only_up).collect()} == {0: 0, 1: 1}


def test_freshness(spark):
    df = spark.createDataFrame([("a", "2024-01-05"), ("b", "2024-01-01")], "s string, d string")
    got = {r.s: (r.is_fresh, r.days_behind) for r in X.freshness(df, "d", F.to_date(F.lit("2024-01-06")), ["s"]).collect()}
    assert got == {"a": (True, 1), "b": (False, 5)}


def test_wide_correlations(spark):
    """Hundreds of columns with gaps: pairs use the rows where both are there; the plan has one block of figures."""
    rng = np.random.default_rng(5)
    n, wide = 60, 500
    base = rng.normal(size=(n, 5))
    values = base @ rng.normal(size=(5, wide)) + rng.normal(size=(n, wide)) + 1e6
    values[rng.random((n, wide)) < 0.1] = np.nan
    pdf = pd.DataFrame(values, columns=[f"c{i:03d}" for i in range(wide)])
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in pdf.columns])
    got = X.correlations(df, digits=9)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("corr(") <= X.CORR_BLOCK**2
    rows = got.toPandas().pivot(index="a", columns="b", values="r")
    assert rows.shape == (wide, wide) and np.allclose(rows.to_numpy(), pdf.corr().to_numpy(), atol=1e-6)
    few = X.correlations(df, ["c001", "c000"], digits=9, block=1).collect()
    assert sorted((r.a, r.b) for r in few) == [("c000", "c000"), ("c000", "c001"), ("c001", "c000"), ("c001", "c001")]
    assert X.correlations(df.select(F.lit("x").alias("t"))).count() == 0
