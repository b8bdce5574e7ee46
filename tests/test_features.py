"""Indicators and the feature matrix against straight pandas formulas, for any way of cutting."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from helpers import ticks_frame, walk
from pyspark.sql import functions as F

from pricetide.operators import indicators as I
from pricetide.operators.scaler import expanding
from pricetide.operators.series import (
    Ema,
    Layout,
    dense_index,
    earlier_totals,
    ema,
    halo_rows,
    home_rows,
    pick_cell_seconds,
    series,
    span_alpha,
    tail_rows,
)
from pricetide.plans.features import FEATURES, ONE_MINUTE, THIRTY_MINUTES, feature_matrix
from pricetide.session import shared_folder

CUTS = [
    Layout(),
    Layout(chunk_rows=512, sub_rows=128, group_rows=2),
    Layout(chunk_rows=7, sub_rows=300, cell_seconds=3600, group_rows=3),
]


class Mean:
    """An exponential mean that starts with its first value."""

    def __init__(self, alpha: float):
        self.alpha, self.value = alpha, None

    def __call__(self, x: float) -> float:
        self.value = x if self.value is None else self.value + self.alpha * (x - self.value)
        return self.value


def between(x: float, low: float, high: float) -> float:
    return x if math.isnan(x) else min(max(x, low), high)


def deviation(values: list[float], n: int, ddof: int = 1) -> float:
    """Of the last ``n`` values; missing until there are as many."""
    last = values[-n:]
    return float(np.std(last, ddof=ddof)) if len(last) == n else math.nan


def ratio(a: float, b: float, empty: float) -> float:
    """a / b - 1, or ``empty`` where that is no finite number."""
    if math.isnan(a) or math.isnan(b) or b == 0:
        return empty
    return a / b - 1


def expected(d: pd.DataFrame, spec) -> pd.DataFrame:
    """Every feature from its definition, one row after the other."""
    price, volume = d.price.tolist(), d.volume.tolist()
    spans = {n: Mean(span_alpha(n)) for n in I.EMA_SPANS}
    fast, slow, signal, gain, loss = (Mean(a) for a in (span_alpha(12), span_alpha(26), span_alpha(9), 1 / 14, 1 / 14))
    returns: list[float] = []
    known = before_known = math.nan
    balance, rows = 0.0, []
    last = {n: math.nan for n in I.EMA_SPANS}
    for i, (p, v) in enumerate(zip(price, volume)):
        row = dict(d.iloc[i])
        before = price[i - 1] if i else math.nan
        returns.append(between(p / before - 1, -spec.ret_clip, spec.ret_clip) if i else 0.0)
        row["ret"] = returns[-1]
        known, before_known = (known if math.isnan(v) else v), known
        row["vol_chg"] = ratio(known, before_known, 0.0)
        row["log_vol"] = math.log1p(v) if not math.isnan(v) else math.nan
        for n in I.RETURN_LAGS:
            row[f"ret_lag_{n}"] = returns[i - n] if i >= n else math.nan
        for n, mean in spans.items():
            e = mean(p)
            row[f"ema_gap_{n}"] = between(p / e - 1, -0.2, 0.2)
            row[f"ema_slope_{n}"] = between(ratio(e, last[n], math.nan), -0.1, 0.1)
            last[n] = e
        for n in I.STD_WINDOWS:
            row[f"rstd_{n}"] = between(deviation(returns, n), 0.0, spec.std_clip)
        if i:
            up, down = gain(max(p - before, 0.0)), loss(max(before - p, 0.0))
            row["rsi_14"] = 100 - 100 / (1 + up / (down + spec.eps))
        else:
            row["rsi_14"] = 50.0
        row["macd"] = fast(p) - slow(p)
        row["macd_signal"] = signal(row["macd"])
        row["macd_hist"] = row["macd"] - row["macd_signal"]
        window = price[max(0, i - 19) : i + 1]
        row["bb_width"] = 4 * deviation(window, 20) / (sum(window) / 20 + spec.eps) if len(window) == 20 else 0.0
        old = balance
        if i and not math.isnan(v):
            balance += v * ((p > before) - (p < before))
        row["obv"] = balance
        row["obv_chg"] = between(ratio(balance, old, 0.0), -0.5, 0.5) if i else 0.0
        minute = d.ts.iloc[i].hour * 60 + d.ts.iloc[i].minute
        row["sin_m"], row["cos_m"] = math.sin(2 * math.pi * minute / 1440), math.cos(2 * math.pi * minute / 1440)
        then = price[i + spec.horizon] if i + spec.horizon < len(price) else math.nan
        row[spec.target] = between(then / p - 1, -spec.target_clip, spec.target_clip)
        rows.append(row)
    return pd.DataFrame(rows)


def agree(got: pd.DataFrame, want: pd.DataFrame, columns) -> None:
    assert len(got) == len(want)
    for c in columns:
        a, b = got[c].to_numpy(float), want[c].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), c
        assert np.allclose(a, b, rtol=1e-8, atol=1e-8, equal_nan=True), c


@pytest.mark.parametrize("cut", CUTS, ids=lambda c: f"{c.chunk_rows}x{c.sub_rows}")
def test_matrix_h30_any_cut(spark, cut):
    sizes = {"a": 3000, "b": 1, "c": 2, "d": 30, "e": 61}
    pdf = pd.concat([walk(n, s, seed=i) for i, (s, n) in enumerate(sizes.items())])
    got = feature_matrix(ticks_frame(spark, pdf), THIRTY_MINUTES, cut).toPandas()
    got = got.sort_values(["symbol", "gi"]).reset_index(drop=True)
    want = pd.concat([expected(g, THIRTY_MINUTES) for _, g in pdf.groupby("symbol")]).reset_index(drop=True)
    agree(got, want, (*FEATURES, THIRTY_MINUTES.target))


def test_matrix_one_minute_drops_incomplete_rows_and_staging_agrees(spark):
    pdf = walk(700)
    cut = Layout(chunk_rows=256, sub_rows=256)
    frame = ticks_frame(spark, pdf)
    got = feature_matrix(frame, ONE_MINUTE, cut, staged=False).toPandas().sort_values("gi")
    want = expected(pdf, ONE_MINUTE).dropna(subset=[*FEATURES, ONE_MINUTE.target])
    assert got["gi"].tolist() == want.index.tolist()
    agree(got.reset_index(drop=True), want.reset_index(drop=True), (*FEATURES, ONE_MINUTE.target))


def test_limit_moves_the_origin(spark):
    pdf = walk(900)
    got = feature_matrix(ticks_frame(spark, pdf), THIRTY_MINUTES, limit=400).toPandas().sort_values("gi")
    want = expected(pdf.tail(400), THIRTY_MINUTES)
    agree(got.reset_index(drop=True), want, FEATURES)


def test_empty_input(spark):
    assert feature_matrix(ticks_frame(spark, walk(0)), ONE_MINUTE).count() == 0


def test_flat_series_has_no_strength_and_no_spread(spark):
    pdf = walk(100)
    pdf["price"], pdf["volume"] = 100.0, 5.0
    got = feature_matrix(ticks_frame(spark, pdf), THIRTY_MINUTES).toPandas().sort_values("gi")
    assert got["rsi_14"].iloc[0] == 50.0 and (got["rsi_14"].iloc[1:] == 0).all()
    assert (got["rstd_5"].dropna() == 0).all() and (got["bb_width"] == 0).all()
    assert (got["ret"] == 0).all() and (got["obv"] == 0).all()


def test_zero_prices_and_volumes(spark):
    pdf = walk(8)
    pdf["price"] = [0.0, 5.0, 0.0, 0.0, 2.0, 2.1, 0.0, 1.0]
    pdf["volume"] = [0.0, 3.0, np.nan, 6.0, -1.0, -2.0, 0.0, 4.0]
    got = feature_matrix(ticks_frame(spark, pdf), THIRTY_MINUTES).toPandas().sort_values("gi")
    # up from zero is the upper limit, 0/0 is none, a fall to zero is the lower limit
    assert np.allclose(got["ret"], [0, 0.1, -0.1, 0, 0.1, 0.05, -0.1, 0.1])
    # 0 -> 3 has no ratio, the missing volume is filled with 3
    assert np.allclose(got["vol_chg"], [0, 0, 0, 1, -1 / 6 - 1, 1, -1, 0])
    logs = got["log_vol"].to_numpy()
    assert logs[4] == 0 and np.isnan(logs[5]) and np.isnan(logs[2])


def test_slow_average_needs_several_blocks(spark):
    pdf = walk(6000)
    cut = Layout(chunk_rows=64, sub_rows=640)
    specs = {"quick": Ema("price", span_alpha(2)), "slow": Ema("price", span_alpha(400))}
    # These forget within a block faster than a double can hold the inverse of.
    specs |= {f"fast{a}": Ema("price", a) for a in (0.67, 0.7, 0.9, 0.999)} | {"late": Ema("price", 0.8, first=700)}
    specs["fast_seeded"] = Ema("price", 0.9, seed=50.0)
    specs["seeded"] = Ema("price", 0.2, seed=0.01)
    df, cut = series(ticks_frame(spark, pdf), cut, back=halo_rows([s.alpha for s in specs.values()], cut.sub_rows))
    got = home_rows(ema(df, cut, specs)).toPandas().sort_values("gi")
    assert np.allclose(got["quick"], pdf.price.ewm(span=2, adjust=False).mean(), rtol=1e-12)
    assert np.allclose(got["slow"], pdf.price.ewm(span=400, adjust=False).mean(), rtol=1e-12)
    for a in (0.67, 0.7, 0.9, 0.999):
        assert np.allclose(got[f"fast{a}"], pdf.price.ewm(alpha=a, adjust=False).mean(), rtol=1e-12)
    assert got["late"].isna().sum() == 700
    assert np.allclose(got["late"].iloc[700:], pdf.price.iloc[700:].ewm(alpha=0.8, adjust=False).mean(), rtol=1e-12)
    fast = pd.concat([pd.Series([50.0]), pdf.price]).ewm(alpha=0.9, adjust=False).mean().iloc[1:]
    assert np.allclose(got["fast_seeded"], fast, rtol=1e-12)
    seeded = pd.concat([pd.Series([0.01]), pdf.price]).ewm(alpha=0.2, adjust=False).mean().iloc[1:]
    assert np.allclose(got["seeded"], seeded, rtol=1e-12)


def test_dense_index_orders_ties_and_crosses_cells(spark):
    pdf = pd.concat([walk(500, "a"), walk(300, "b")])
    pdf["ts"] = pdf["ts"].dt.floor("10min")
    got = dense_index(ticks_frame(spark, pdf), Layout()).toPandas().sort_values(["symbol", "gi"])
    for _, g in got.groupby("symbol"):
        assert g["gi"].tolist() == list(range(len(g)))
        assert g["seq"].tolist() == sorted(g["seq"].tolist())


def test_pick_cell_seconds(spark):
    frame = ticks_frame(spark, walk(500))
    assert pick_cell_seconds(frame, Layout(), max_rows=1000) == 86400
    assert pick_cell_seconds(frame, Layout(), max_rows=100) == 3600
    assert pick_cell_seconds(frame, Layout(), max_rows=15) == 600
    assert pick_cell_seconds(frame, Layout(), max_rows=5) == 60


@pytest.mark.parametrize("n", [1, 7, 120, 10_000])
def test_tail_rows(spark, n):
    pdf = pd.concat([walk(400, "a"), walk(50, "b")])
    got = tail_rows(ticks_frame(spark, pdf), Layout(), n).toPandas()
    want = pdf.groupby("symbol").tail(n)
    assert sorted(zip(got.symbol, got.seq)) == sorted(zip(want.symbol, want.seq))


def test_expanding_scaler_any_cut(spark):
    pdf = pd.concat([walk(700, "a"), walk(1, "b")])
    for cut in CUTS:
        df, used = series(ticks_frame(spark, pdf), cut)
        got = home_rows(expanding(df, used, ["price", "volume"])).toPandas().sort_values(["symbol", "gi"])
        for s, g in got.groupby("symbol"):
            d = pdf[pdf.symbol == s].reset_index(drop=True)
            for c in ("price", "volume"):
                mean, std = d[c].expanding().mean(), d[c].expanding().std(ddof=0)
                assert np.allclose(g[f"{c}_mean"], mean, equal_nan=True, rtol=1e-10)
                assert np.allclose(g[f"{c}_std"].fillna(0), std.fillna(0), atol=1e-9)


def test_symbols_do_not_mix_and_no_window_spans_a_symbol(spark):
    """Every window over data rows is partitioned by a run or a time cell as well."""
    df = feature_matrix(ticks_frame(spark, walk(100)), ONE_MINUTE, staged=False)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    for line in windows:
        inside = line[line.index("windowspecdefinition(") :]
        keys = inside.split(" ASC")[0]
        # Totals of runs and cells: by groups of them, or over the groups.
        assert "chunk#" in keys or "_cell#" in keys or "_group#" in keys, line[:200]


def test_shared_folder_is_the_cluster_setting():
    class Conf(dict):
        def get(self, key, default):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, master, **conf):
            self.conf = Conf(conf)
            self.sparkContext = type("Context", (), {"master": master, "applicationId": master})

    assert shared_folder(Session("yarn", **{"spark.checkpoint.dir": "hdfs:///c/"})) == "hdfs:///c"
    with pytest.raises(ValueError):
        shared_folder(Session("yarn"))
    assert shared_folder(Session("local[2]")) == shared_folder(Session("local[2]"))


@pytest.mark.parametrize("group", [1, 2, 5, 1000])
def test_totals_of_earlier_rows_by_two_levels(spark, group):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b", "c"], [40, 1, 17]), "p": [*range(0, 120, 3), 5, *range(100, 117)]})
    pdf["x"] = np.where(r.random(len(pdf)) < 0.3, np.nan, r.normal(1, 0.2, len(pdf)))
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=0)).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    x = F.col("x")
    totals = {"s": ("sum", x), "m": ("product", x), "h": ("max", x), "l": ("last", x)}
    got = earlier_totals(df, "k", "p", totals, group).toPandas().sort_values(["k", "p"]).reset_index(drop=True)
    for _, rows in pdf.groupby("k"):
        own = got[got.k == rows.k.iloc[0]].reset_index(drop=True)
        for i in range(len(rows)):
            before = rows.x.iloc[:i].dropna()
            assert own.s[i] == pytest.approx(before.sum()) and own.m[i] == pytest.approx(before.prod())
            for name, want in (("h", before.max() if len(before) else None), ("l", before.iloc[-1] if len(before) else None)):
                assert (pd.isna(own[name][i]) and want is None) or own[name][i] == pytest.approx(want)
    with pytest.raises(ValueError):
        earlier_totals(df, "k", "p", {"s": ("median", x)}, group)


def test_windows_over_a_whole_symbol_see_groups_only(spark):
    """Every window by the symbol alone stands on an aggregation by (symbol, group)."""
    plan = feature_matrix(ticks_frame(spark, walk(50)), ONE_MINUTE, staged=False)._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window [" in line and re.search(r"\], \[symbol#\d+\], \[", line)]
    assert whole and all(re.search(r"\], \[symbol#\d+\], \[_group#", line) for line in whole)
