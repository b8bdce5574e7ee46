"""Members, forecasting loop, calibration, and the stream against the batch."""

import json
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from helpers import ticks_frame, walk

from pricetide.operators.learners import DEFAULTS, MEMBER_RULES, Learner, Panel, finite
from pricetide.operators.online import ONE_MINUTE_LOOP, THIRTY_MINUTE_LOOP, ForecastLoop
from pricetide.operators.series import Layout
from pricetide.plans import forecast as L
from pricetide.plans.features import FEATURES, ONE_MINUTE, THIRTY_MINUTES, feature_matrix
from pricetide.session import scratch_path
from pricetide.sources import tables as W
from pricetide.streaming import ingest
from pricetide.streaming.incremental import FeatureState
from pricetide.streaming.online import BAR_COLUMNS, forecast_stream, initial_states

SHORT = replace(ONE_MINUTE_LOOP, min_history=80, init_rows=0)


def bar_walk(n, symbol="a", seed=4):
    pdf = walk(n, symbol, seed, missing=0.0)
    pdf["ts"] = pdf["ts"].dt.floor("min")
    return pdf


def test_scaler_blocks_and_rows_agree():
    x = np.random.default_rng(0).normal(5, 3, (200, 4))
    one, many = Learner("ridge", {"alpha": 1e-4}, 4), Learner("ridge", {"alpha": 1e-4}, 4)
    one._observe(x)
    many._observe(x[:50])
    for row in x[50:]:
        many._observe_one(row)
    assert np.allclose(one.mean, x.mean(0)) and np.allclose(many.mean, one.mean)
    assert np.allclose(many.spread / many.seen, x.var(0))
    flat = Learner("ridge", {"alpha": 1e-4}, 1)
    flat._observe(np.ones((5, 1)))
    assert flat._scaled(np.array([3.0])) == 2.0


def test_passive_aggressive_step():
    rule = MEMBER_RULES["pa"](C=10.0, tolerance=0.1)
    x = np.array([1.0, 2.0])
    w = rule(np.zeros(3), 0, x, 1.1)
    # a step of (miss - tolerance) / |x|^2 along x
    assert np.allclose(w, [0.2, 0.4, 0.2])
    assert np.allclose(MEMBER_RULES["pa"](C=0.1, tolerance=0.1)(np.zeros(3), 0, x, 1.1), [0.1, 0.2, 0.1])
    assert np.allclose(rule(np.zeros(3), 0, x, 0.05), 0)


def test_gradient_steps_follow_the_published_rule():
    alpha, eps = 0.01, 0.5
    typical = np.sqrt(1 / np.sqrt(alpha))
    start = 1 / (typical * alpha)
    for name, settings, limit in (("sgd", {"epsilon": eps, "alpha": alpha}, eps), ("ridge", {"alpha": alpha}, np.inf)):
        rule, w, b = MEMBER_RULES[name](**settings), np.zeros(2), 0.0
        state = np.zeros(3)
        rng = np.random.default_rng(1)
        for t in range(20):
            x, y = rng.normal(size=2), rng.normal()
            rate = 1 / (alpha * (start + t))
            g = np.clip(w @ x + b - y, -limit, limit)
            w, b = w * max(0, 1 - rate * alpha) - rate * g * x, b - rate * g
            state = rule(state, t, x, y)
        assert np.allclose(state, [*w, b])


def test_missing_inputs_count_as_zero():
    assert finite([np.nan, np.inf, -np.inf, 2.0]).tolist() == [0, 0, 0, 2.0]


def test_loop_state_round_trip():
    pdf = bar_walk(200)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    minutes = (pdf.ts.astype("int64") // 10**9).to_numpy() if pdf.ts.dtype == "datetime64[ns]" else pdf.ts.astype("datetime64[s]").astype("int64").to_numpy()
    for spec in (SHORT, replace(THIRTY_MINUTE_LOOP, min_history=40)):
        whole, first = ForecastLoop(spec, 3), ForecastLoop(spec, 3)
        want = [whole.step(int(minutes[i]), pdf.price[i], x[i]) for i in range(200)]
        got = [first.step(int(minutes[i]), pdf.price[i], x[i]) for i in range(100)]
        second = ForecastLoop(spec, 3).load(json.loads(json.dumps(first.dump())))
        got += [second.step(int(minutes[i]), pdf.price[i], x[i]) for i in range(100, 200)]
        assert got == want and sum(f is not None for f in got) > 100
        assert whole.step(int(minutes[0]), 1.0, x[0]) is None


def test_weights_used_are_those_before_or_after_scoring():
    late, early = ForecastLoop(replace(SHORT, min_history=1), 1), ForecastLoop(
        replace(SHORT, min_history=1, weights_after_update=True), 1
    )
    for loop in (late, early):
        loop.step(0, 100.0, [0.0])
        loop.open[60]["sgd"] = 90.0
    a, b = late.step(60, 100.0, [0.0]), early.step(60, 100.0, [0.0])
    assert a["w_sgd"] == pytest.approx(1 / 3) and b["w_sgd"] < 0.01
    assert a["mae"] is not None


def test_label_by_time_waits_for_the_exact_minute():
    loop = ForecastLoop(replace(THIRTY_MINUTE_LOOP, min_history=1), 1)
    loop.step(0, 100.0, [1.0])
    loop.step(29 * 60, 101.0, [1.0])
    assert loop.members["sgd"].steps == 0
    loop.step(30 * 60, 102.0, [1.0])
    assert loop.members["sgd"].steps == 1
    # the bar of minute 59 never comes: its label is skipped and forgotten
    loop.step(61 * 60, 103.0, [1.0])
    assert loop.members["sgd"].steps == 1 and 29 * 60 not in loop.waiting


def test_replay_has_no_lookahead_and_bounded_rows(spark):
    pdf = bar_walk(400)
    changed = pdf.copy()
    changed.loc[300:, "price"] *= 1.5
    a = L.replay(ticks_frame(spark, pdf), SHORT, ONE_MINUTE).toPandas().sort_values("target")
    b = L.replay(ticks_frame(spark, changed), SHORT, ONE_MINUTE).toPandas().sort_values("target")
    cut = pdf.ts[300]
    early = lambda d: d[d.target <= cut].drop(columns="target").fillna(-1)
    assert len(early(a)) == 221 and np.allclose(early(a).drop(columns="symbol"), early(b).drop(columns="symbol"))
    assert np.allclose(a[["w_sgd", "w_ridge", "w_pa"]].sum(axis=1), 1)
    limited = L.replay(ticks_frame(spark, pdf), replace(SHORT, max_rows=100), ONE_MINUTE)
    assert limited.count() == 21


def test_initial_block_and_thirty_minute_horizon(spark):
    pdf = pd.concat([bar_walk(500, "a"), bar_walk(50, "b")])
    loop = replace(THIRTY_MINUTE_LOOP, min_history=200, init_rows=150)
    got = L.replay(ticks_frame(spark, pdf), loop, THIRTY_MINUTES).toPandas()
    assert set(got.symbol) == {"a"} and len(got) == 301
    assert (got.target - pd.Timestamp("2024-01-01")).dt.total_seconds().min() == (199 + 30) * 60
    assert ((got.y_hat / got.baseline - 1).abs() <= 0.15 + 1e-12).all()


def test_lines_of_a_panel_move_like_single_learners():
    """Same scaler, same rows: every line does what a learner of its own does."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 6)), rng.normal(size=200) * 0.2
    # A squared loss takes steps that are too long at the fixed settings; with these its rounding dies out.
    grid = [{**g, "ridge": {"alpha": a}} for g, a in zip(L.GRID[:2], (100.0, 300.0))]
    panel = Panel(grid, 6)
    for row in x[:80]:
        panel.observe(row)
    single = [Learner(m, grid[s][m], 6) for s, m in panel.lines]
    for one in single:
        one.seen, one.mean, one.spread = panel.seen, panel.mean.copy(), panel.spread.copy()
    for i in range(200):
        made = panel.predict(x[i])
        assert np.allclose(made, [one.predict(x[i]) for one in single], rtol=1e-9, atol=1e-12)
        panel.update(x[i], y[i])
        for one in single:
            one.update(x[i], y[i])
    block = Learner("pa", L.GRID[0]["pa"], 6)
    block.fit(x[:80], y[:80])
    fresh = Panel(grid, 6)
    for row in x[:80]:
        fresh.observe(row)
    assert np.allclose(block.mean, fresh.mean) and np.allclose(block.spread, fresh.spread)


def test_walk_forward_matches_a_plain_replay(spark):
    feats = feature_matrix(ticks_frame(spark, bar_walk(460)), ONE_MINUTE)
    grid = L.GRID[:2]
    got = {(r.hp_id, r.fold): r.mae for r in L.walk_forward(feats, grid, min_rows=100).collect()}
    first = {(r.hp_id, r.fold): r.mae for r in L.walk_forward(feats, grid, min_rows=100, learn_first=True).collect()}
    pdf = feats.toPandas().sort_values("gi")
    x, y = finite(pdf[list(FEATURES)]), pdf["y_ret"].to_numpy()
    step = len(y) // 4
    for fold in (1, 2, 3):
        for found, learn_first in ((got, False), (first, True)):
            panel = Panel(list(grid), len(FEATURES))
            for row in x[: fold * step]:
                panel.observe(row)
            for row, target in zip(x[: fold * step], y):
                panel.learn(panel.scaled(row), target)
            off = np.zeros(2)
            for row, target in zip(x[fold * step : (fold + 1) * step], y[fold * step :]):
                if learn_first:
                    panel.update(row, target)
                made = np.clip(panel.predict(row), -0.05, 0.05)
                off += [abs(made[[s == hp for s, _ in panel.lines]].mean() - target) for hp in (0, 1)]
                if not learn_first:
                    panel.update(row, target)
            for hp in (0, 1):
                assert found[hp, fold] == pytest.approx(off[hp] / step, rel=1e-9)
    again = {(r.hp_id, r.fold): r.mae for r in L.walk_forward(feats.repartition(5), L.GRID[:2], min_rows=100).collect()}
    assert again == {(r.hp_id, r.fold): r.mae for r in L.walk_forward(feats, L.GRID[:2], min_rows=100).collect()}
    assert L.walk_forward(feats, L.GRID[:1], min_rows=5000).count() == 0
    shifted = L.walk_forward(feats, L.GRID[:1], L.LIGHT, min_rows=100, target_offset=1).collect()
    assert len(shifted) == 1 and shifted[0].mae > 0


def test_first_setting_wins_a_tie(spark):
    rows = [("a", 1, 1, 0.5), ("a", 0, 1, 0.5), ("a", 2, 1, 0.6)]
    best = L.grid_winner(spark.createDataFrame(rows, "symbol string, hp_id int, fold int, mae double")).first()
    assert (best.hp_id, best.mae) == (0, 0.5)


@pytest.mark.parametrize("spec", [ONE_MINUTE, THIRTY_MINUTES], ids=["1m", "h30"])
def test_incremental_features_equal_the_batch(spark, spec):
    pdf = walk(300)
    pdf.loc[5, "volume"] = 0.0
    batch = feature_matrix(ticks_frame(spark, pdf), replace(spec, drop_null=False)).toPandas().sort_values("gi")
    state, rows = FeatureState(spec), []
    for i, r in enumerate(pdf.itertuples()):
        if i == 150:
            state = FeatureState(spec).load(json.loads(json.dumps(state.dump())))
        rows.append(state.push(r.ts.timestamp(), r.price, r.open, r.volume, r.return_pct))
    got = np.array(rows)
    want = batch[list(FEATURES)].to_numpy(float)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.allclose(got, want, equal_nan=True, rtol=1e-8, atol=1e-8)


def land(spark, pdf, files):
    """Write rows as files in time order, one at a time so that the stream sees that order."""
    folder = scratch_path(spark, "landed")
    for i, part in enumerate(np.array_split(np.arange(len(pdf)), files)):
        ticks_frame(spark, pdf.iloc[part]).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_bars_equal_batch_and_restart_changes_nothing(spark):
    pdf = walk(600, missing=0.0)
    pdf.loc[10, "ts"] = pdf.loc[9, "ts"]
    folder = land(spark, pdf, 4)
    out, state = scratch_path(spark, "bars"), scratch_path(spark, "state")
    schema = ticks_frame(spark, pdf).schema

    def run():
        ticks = ingest.tick_stream(spark, folder, schema, files_per_batch=1)
        stream = ingest.stream_bars(ticks, "5 minutes")
        ingest.start(stream, ingest.upsert_sink(out, ["symbol", "minute"]), state, "update", None).awaitTermination()
        return W.latest(spark.read.parquet(out), ["symbol", "minute"]).toPandas().sort_values("minute")

    first = run()
    want = pdf.sort_values(["ts", "seq"]).groupby(pdf.ts.dt.floor("5min")).agg(price=("price", "last"), volume=("volume", "sum"), n=("seq", "size"))
    assert first.minute.tolist() == want.index.tolist() and first.version.nunique() > 1
    for c in ("price", "volume", "n"):
        assert np.allclose(first[c], want[c])
    pd.testing.assert_frame_equal(first.reset_index(drop=True), run().reset_index(drop=True))


def test_stream_drops_copies(spark):
    pdf = walk(40, missing=0.0)
    folder = land(spark, pd.concat([pdf, pdf]), 1)
    ticks = ingest.tick_stream(spark, folder, ticks_frame(spark, pdf).schema)
    out, state = scratch_path(spark, "once"), scratch_path(spark, "state")
    ingest.start(ingest.without_duplicates(ticks), lambda d, i: W.write_version(d, out, i), state, every=None).awaitTermination()
    assert spark.read.parquet(out).count() == 40


def test_stream_forecasts_equal_the_replay(spark):
    pdf = pd.concat([bar_walk(160, "a"), bar_walk(160, "b", seed=8)]).sort_values("ts")
    folder = land(spark, pdf, 3)
    schema = ticks_frame(spark, pdf).schema
    bars = ingest.tick_stream(spark, folder, schema, files_per_batch=1).withColumnRenamed("ts", "minute")
    bars = bars.select("symbol", "minute", *BAR_COLUMNS)
    out, state = scratch_path(spark, "forecasts"), scratch_path(spark, "state")
    sink = ingest.upsert_sink(out, ["symbol", "target"])
    ingest.start(forecast_stream(bars, SHORT, ONE_MINUTE), sink, state, every=None).awaitTermination()
    got = W.latest(spark.read.parquet(out), ["symbol", "target"]).toPandas().sort_values(["symbol", "target"])
    want = L.replay(ticks_frame(spark, pdf), SHORT, ONE_MINUTE).toPandas().sort_values(["symbol", "target"])
    assert got.version.nunique() > 1 and len(got) == len(want) == 2 * 81
    for c in L.FORECAST_COLUMNS[2:]:
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True, rtol=1e-6), c


def test_stream_from_history_goes_on_like_the_whole_history(spark):
    """State built from the first bars, then the stream of the rest, equals one replay."""
    pdf = bar_walk(200)
    loop = replace(SHORT, init_rows=50)
    old = ticks_frame(spark, pdf.iloc[:120]).withColumnRenamed("ts", "minute")
    folder = land(spark, pdf.iloc[120:], 2)
    bars = ingest.tick_stream(spark, folder, ticks_frame(spark, pdf).schema, files_per_batch=1)
    bars = bars.withColumnRenamed("ts", "minute").select("symbol", "minute", *BAR_COLUMNS)
    start = initial_states(old, loop, ONE_MINUTE, Layout(order=("minute",)))
    out, state = scratch_path(spark, "continued"), scratch_path(spark, "state")
    stream = forecast_stream(bars, loop, ONE_MINUTE, initial=start)
    ingest.start(stream, ingest.upsert_sink(out, ["symbol", "target"]), state, every=None).awaitTermination()
    got = spark.read.parquet(out).toPandas().sort_values("target")
    want = L.replay(ticks_frame(spark, pdf), loop, ONE_MINUTE).toPandas().sort_values("target").tail(80)
    assert len(got) == 80
    for c in L.FORECAST_COLUMNS[2:]:
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True, rtol=1e-6), c


def test_published_settings_reach_the_replay(spark):
    frame = ticks_frame(spark, bar_walk(150))
    winner = spark.createDataFrame([("a", 3, 0.1)], "symbol string, hp_id int, mae double")
    meta = L.published(winner).unionByName(W.meta_row(spark, "b:v4_state", "no settings"))
    tuned = L.tuned_settings(meta)
    assert [(r.symbol, r.hps.pa.C) for r in tuned.collect()] == [("a", 0.75)]
    a = L.replay(frame, SHORT, ONE_MINUTE, tuned=tuned).toPandas().sort_values("target")
    b = L.replay(frame, SHORT, ONE_MINUTE, settings=L.GRID[3]).toPandas().sort_values("target")
    assert np.allclose(a.y_hat, b.y_hat)


def test_settings_that_make_no_sense_are_refused(spark):
    with pytest.raises(ValueError, match="huber"):
        Panel([{"sgd": {"alpha": 1e-4}, "huber": {}}], 3)
    early = replace(ONE_MINUTE_LOOP, min_history=100, init_rows=600)
    frame = ticks_frame(spark, bar_walk(10))
    with pytest.raises(ValueError, match="min_history"):
        L.replay(frame, early, ONE_MINUTE)
    with pytest.raises(ValueError, match="min_history"):
        initial_states(frame.withColumnRenamed("ts", "minute"), early, ONE_MINUTE, Layout(order=("minute",)))


def test_metadata_of_both_horizons(spark):
    winner = spark.createDataFrame([("a", 3, 0.1), ("b", 0, 0.2)], "symbol string, hp_id int, mae double")
    errors = spark.createDataFrame([("a", 1, 0.1, 0.2, 0.3), ("a", 2, 0.5, None, 0.7)], "symbol string, target int, mae_sgd double, mae_ridge double, mae_pa double")
    meta = L.published(winner, horizon=30).unionByName(L.error_averages(errors, 1)).unionByName(W.meta_row(spark, "c:v4_ewm_mae", "none"))
    assert sorted((r.symbol, r.hps.pa.C, r.mae) for r in L.tuned_settings(meta, 30).collect()) == [("a", 0.75, 0.1), ("b", 0.25, 0.2)]
    assert L.tuned_settings(meta).count() == 0 and L.stored_averages(meta, 30).count() == 0
    assert [tuple(r) for r in L.stored_averages(meta).collect()] == [("a", 0.5, None, 0.7)]


def test_equal_keys_of_a_batch_are_stored_once(spark):
    out = scratch_path(spark, "once")
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 7.0), ("b", 1, 1.0), (None, 1, 1.0)], "symbol string, k int, v double")
    ingest.upsert_sink(out, ["symbol", "k"])(rows, 0)
    assert sorted(r.symbol for r in spark.read.parquet(out).collect()) == ["a", "b"]
    ingest.upsert_sink(out, ["symbol", "k"], ["v"])(rows, 0)
    assert sorted((r.symbol, r.v) for r in spark.read.parquet(out).collect()) == [("a", 7.0), ("b", 1.0)]
