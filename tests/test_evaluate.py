"""Evaluation, alerts, weights and backtest against pandas and small hand-made cases."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricetide.operators import evaluate as E
from pricetide.operators.backtest import LAYOUT, backtest, summary
from pricetide.operators.bars import bars, newest
from pricetide.operators.series import Layout

T0 = pd.Timestamp("2024-03-01 10:00")


def scored(n=400, symbol="a", seed=3, pending=0.1):
    rng = np.random.default_rng(seed)
    real = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    real[rng.random(n) < pending] = np.nan
    base = 100 + rng.normal(0, 1, n)
    y = base * (1 + rng.normal(0, 0.001, n))
    out = pd.DataFrame({"symbol": symbol, "target": T0 + pd.to_timedelta(np.arange(n), unit="min")})
    out["y_hat"], out["y_hat_ret"], out["baseline"], out["price_real"] = y, y / base - 1, base, real
    for i, m in enumerate(("sgd", "ridge", "pa")):
        out[f"y_hat_{m}"] = y + i * 0.1
    return out


def frame(spark, pdf):
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1))
    return df.withColumn("price_real", F.when(~F.isnan("price_real"), F.col("price_real"))).repartition(3)


def test_bars_take_the_last_tick_and_joins_do_not_fan_out(spark):
    rows = [("a", "2024-01-01 00:00:10", 1, 1.0, 2.0), ("a", "2024-01-01 00:00:50", 2, 3.0, 4.0)]
    rows += [("a", "2024-01-01 00:00:50", 3, 5.0, 1.0), ("a", "2024-01-01 00:02:00", 4, 7.0, 1.0)]
    ticks = spark.createDataFrame(rows, "symbol string, ts string, seq long, price double, volume double")
    b = bars(ticks.withColumn("ts", F.col("ts").cast("timestamp")))
    got = {str(r.minute): (r.price, r.volume, r.n) for r in b.collect()}
    assert got == {"2024-01-01 00:00:00": (5.0, 7.0, 3), "2024-01-01 00:02:00": (7.0, 1.0, 1)}
    preds = spark.createDataFrame(
        [("a", "2024-01-01 00:00:00", 4.0, 3.0), ("a", "2024-01-01 00:01:00", 4.0, 3.0)],
        "symbol string, target string, y_hat double, baseline double",
    ).withColumn("target", F.col("target").cast("timestamp"))
    out = {str(r.target)[14:16]: r for r in E.evaluated(preds, b).collect()}
    assert out["00"].erro == -1.0 and out["00"].acerto_dir == 1.0 and out["00"].melhor_que_base == 1.0
    assert out["01"].price_real is None and out["01"].acerto_dir is None and out["01"].melhor_que_base is None


def test_direction_of_equal_signs_counts_as_hit(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 1.0, 1.0), (None, 1.0, 1.0)], "y_hat double, price_real double, baseline double")
    got = [r.acerto_dir for r in E.with_errors(df).collect()]
    assert got == [1.0, 0.0, None]


def test_figures(spark):
    pdf = scored()
    rows = E.with_errors(frame(spark, pdf))
    got = E.kpis(rows).first()
    d = pdf.dropna(subset=["price_real"])
    err = d.y_hat - d.price_real
    assert got.n == len(pdf) and got.pending == len(pdf) - len(d)
    assert np.isclose(got.mae, err.abs().mean()) and np.isclose(got.rmse, np.sqrt((err**2).mean()))
    assert np.isclose(got.mape, (err / d.price_real).abs().mean() * 100)
    hit = np.sign(d.y_hat - d.baseline) == np.sign(d.price_real - d.baseline)
    assert np.isclose(got.acc_dir, hit.mean() * 100)
    beat = err.abs() < (d.baseline - d.price_real).abs()
    assert np.isclose(got.beat_base, beat.mean() * 100)


def test_mape_skips_zero_actuals_and_is_null_without_any(spark):
    schema = "symbol string, price_real double, y_hat double"
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0), ("b", 0.0, 1.0), ("c", None, 1.0)], schema)
    got = {r.symbol: r.m for r in df.groupBy("symbol").agg(E.mape().alias("m")).collect()}
    assert got == {"a": 50.0, "b": None, "c": None}


@pytest.mark.parametrize("mae,acc,state", [(2.0, 10.0, "error"), (0.5, 10.0, "warn"), (0.5, 90.0, "ok")])
def test_alert_states(spark, mae, acc, state):
    rows = spark.createDataFrame(
        [("a", T0.to_pydatetime(), mae, acc / 100.0)], "symbol string, target timestamp, erro double, acerto_dir double"
    )
    limits = spark.createDataFrame([("a", 1.0)], "symbol string, err_limit double")
    assert E.alerts(rows, limits).first().state == state


def test_missing_figures_raise_no_alert(spark):
    rows = spark.createDataFrame(
        [("a", T0.to_pydatetime(), None, None)], "symbol string, target timestamp, erro double, acerto_dir double"
    )
    limits = spark.createDataFrame([("a", 0.0)], "symbol string, err_limit double")
    assert E.alerts(rows, limits).first().state == "ok"


def test_alert_window_filters(spark):
    rows = [("a", (T0 + pd.Timedelta(minutes=i)).to_pydatetime(), float(i), 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "symbol string, target timestamp, erro double, acerto_dir double")
    limits = spark.createDataFrame([("a", 100.0)], "symbol string, err_limit double")
    assert E.alerts(df, limits, window_min=5).first().mae == 7.0


@pytest.mark.parametrize("cut", [LAYOUT, replace(LAYOUT, chunk_rows=50, sub_rows=50)])
def test_weights(spark, cut):
    pdf = pd.concat([scored(300, "a"), scored(120, "b", seed=9)])
    got = E.member_weights(frame(spark, pdf), cut).toPandas()
    before = E.member_weights(frame(spark, pdf), cut, after_update=False).toPandas()
    assert np.allclose(got[["w_sgd", "w_ridge", "w_pa"]].sum(axis=1), 1.0)
    for s, d in pdf.dropna(subset=["price_real"]).groupby("symbol"):
        g = got[got.symbol == s].sort_values("gi")
        old = before[before.symbol == s].sort_values("gi")
        for m in ("sgd", "ridge", "pa"):
            mean, want, was = 0.01, [], []
            for e in (d.price_real - d[f"y_hat_{m}"]).abs():
                was.append(mean)
                mean = 0.2 * e + 0.8 * mean
                want.append(mean)
            assert np.allclose(g[f"mae_{m}"], want, rtol=1e-10)
            assert np.allclose(old[f"mae_{m}"], was, rtol=1e-10)


def test_delayed_labels_match_by_time_not_by_row(spark):
    minutes = [0, 10, 30, 31, 60]
    rows = [("a", (T0 + pd.Timedelta(minutes=m)).to_pydatetime(), 100.0 + m) for m in minutes]
    b = spark.createDataFrame(rows, "symbol string, minute timestamp, price double")
    got = {(r.minute.minute, r.label_at.minute + 60 * (r.label_at.hour - 10)): r.y_label for r in E.delayed_labels(b).collect()}
    assert set(got) == {(0, 30), (30, 60)}
    assert np.isclose(got[(0, 30)], 0.15) and np.isclose(got[(30, 60)], 0.15)


def test_anchor_fallbacks(spark):
    cut = Layout(order=("minute",), cell_seconds=3600)
    rows = [("a", (T0 + pd.Timedelta(minutes=m)).to_pydatetime(), float(m)) for m in range(25)]
    close = spark.createDataFrame(rows, "symbol string, minute timestamp, close double")
    got = {r.minute.minute: r.price_t for r in E.with_anchor(close, cut).collect()}
    assert got[5] is None and got[12] == 2.0
    assert E.with_anchor(close.withColumnRenamed("close", "close_t"), cut).where("price_t != close_t").count() == 0
    assert E.with_anchor(close.withColumnRenamed("close", "x"), cut).where("price_t is not null").count() == 0


@pytest.mark.parametrize("cut", [LAYOUT, replace(LAYOUT, chunk_rows=32, sub_rows=32)])
def test_backtest_against_pandas(spark, cut):
    pdf = pd.concat([scored(500, "a"), scored(60, "b", seed=5), scored(1, "c", pending=0)])
    got = backtest(frame(spark, pdf), cut, threshold_bps=2.0, fee_bps=4.0).toPandas()
    totals = {r.symbol: r for r in summary(backtest(frame(spark, pdf), cut, 2.0, 4.0)).collect()}
    for s, d in pdf.groupby("symbol"):
        g = got[got.symbol == s].sort_values("target").reset_index(drop=True)
        # One position, its worth and the highest worth so far, held row by row.
        held, worth, kept, peak = None, 1.0, 1.0, 1.0
        sig, eq, hold, dd = [], [], [], []
        before = math.nan
        for forecast, real in zip(d.y_hat_ret.tolist(), d.price_real.tolist()):
            want = 1 if forecast > 2 / 10_000 else 0
            move = real / before - 1 if not math.isnan(real / before) else 0.0
            worth *= 1 + (held or 0) * move - (4 / 10_000 if held is not None and want != held else 0.0)
            kept *= 1 + move
            peak = max(peak, worth)
            sig.append(want)
            eq.append(worth)
            hold.append(kept)
            dd.append(worth / peak - 1)
            held, before = want, real
        sig, eq, hold, dd = np.array(sig), np.array(eq), np.array(hold), np.array(dd)
        assert (g.signal == sig).all()
        for name, want in (("eq_model", eq), ("eq_hold", hold), ("drawdown", dd)):
            assert np.allclose(g[name], want, rtol=1e-10, atol=1e-12), name
        assert (g.drawdown <= 0).all()
        assert np.isclose(totals[s].total_model, eq[-1] - 1, atol=1e-12)
        assert np.isclose(totals[s].max_drawdown, dd.min(), atol=1e-12)


def test_holding_equals_price_ratio(spark):
    pdf = scored(200, pending=0)
    got = backtest(frame(spark, pdf), LAYOUT).toPandas().sort_values("target")
    assert np.isclose(got.eq_hold.iloc[-1], pdf.price_real.iloc[-1] / pdf.price_real.iloc[0])


def test_recent_backtest_only_sees_the_tail(spark):
    pdf = scored(200, pending=0)
    got = backtest(frame(spark, pdf), LAYOUT, hours=1).toPandas()
    assert len(got) == 60 and got.target.min() == pdf.target.iloc[-60]


def test_heatmap_and_latest(spark):
    rows = E.with_errors(frame(spark, scored(300)))
    got = E.heatmap(rows).first()
    assert got.dia == "Friday" and got.h0 is None and 0 <= got.h11 <= 100
    price = spark.createDataFrame([("a", T0.to_pydatetime(), 1234.5)], "symbol string, minute timestamp, price double")
    last = E.latest_values(rows.withColumn("y_hat", F.lit(None).cast("double")), price).first()
    assert last.last_price_text == "1,234.50" and last.last_pred is None and last.last_pred_text == "—"
    assert newest(rows, "target", 5).count() == 5
