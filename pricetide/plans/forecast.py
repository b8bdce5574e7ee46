"""Batch learning jobs: replay of the forecasting loop, and walk-forward calibration.

A group is one symbol (replay) or one symbol and fold (calibration). Learning is sequential inside a group,
so these jobs scale with the number of groups and not within one. A replay holds the rows its loop is limited
to; calibration takes all rows and streams them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.learners import DEFAULTS, Panel
from pricetide.operators.online import ForecastLoop, LoopSpec, check_block
from pricetide.operators.series import Layout, per_series
from pricetide.plans.features import FEATURES, ONE_MINUTE, FeatureSpec, feature_matrix
from pricetide.schemas import ERROR_KEYS, ERRORS_JSON, HYPERPARAMETERS, MEMBERS, STATE_JSON, STATE_KEYS
from pricetide.sources.tables import meta_decoded, meta_from

FORECAST_SCHEMA = (
    "symbol string, target timestamp, y_hat double, y_hat_ret double, baseline double, mae double, "
    + ", ".join(f"y_hat_{m} double" for m in MEMBERS)
    + ", "
    + ", ".join(f"w_{m} double" for m in MEMBERS)
)
FORECAST_COLUMNS = [part.split()[0] for part in FORECAST_SCHEMA.split(", ")]

# The settings tried by the two calibrations (the light one tries the first three).
GRID = (
    {"sgd": {"epsilon": 1e-3, "alpha": 1e-5}, "ridge": {"alpha": 1e-5}, "pa": {"C": 0.25}},
    {"sgd": {"epsilon": 1e-3, "alpha": 1e-4}, "ridge": {"alpha": 1e-4}, "pa": {"C": 0.5}},
    {"sgd": {"epsilon": 1e-2, "alpha": 1e-4}, "ridge": {"alpha": 1e-3}, "pa": {"C": 1.0}},
    {"sgd": {"epsilon": 5e-3, "alpha": 5e-5}, "ridge": {"alpha": 5e-5}, "pa": {"C": 0.75}},
)


def forecast_frame(symbol: str, forecasts: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(forecasts, columns=FORECAST_COLUMNS)
    out["symbol"] = symbol
    out["target"] = pd.to_datetime(out["target"].astype("int64"), unit="s")
    numbers = [c for c in FORECAST_COLUMNS if c not in ("symbol", "target")]
    return out.astype({c: "float64" for c in numbers})


def replay(
    ticks: DataFrame,
    loop: LoopSpec,
    features: FeatureSpec,
    layout: Layout = Layout(),
    settings: Mapping[str, Mapping[str, float]] = DEFAULTS,
    tuned: DataFrame | None = None,
) -> DataFrame:
    """The forecasts the loop would have made over the newest ``max_rows`` rows of every symbol.

    The first ``init_rows`` rows are learnt as a block with the labels of the feature matrix.
    ``tuned`` (see ``tuned_settings``) overrides ``settings`` for the symbols it names.
    """
    check_block(loop)
    whole = FeatureSpec(**{**features.__dict__, "drop_null": False})
    matrix = feature_matrix(ticks, whole, layout, limit=loop.max_rows)
    target = features.target
    unit = F.lit(loop.bar_seconds)
    rows = matrix.withColumn(
        "_minute", (F.floor(F.unix_seconds(layout.order[0]) / unit) * unit).cast("bigint")
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < loop.min_history:
            return forecast_frame(key[0], [])
        pdf = pdf.sort_values("gi")
        x = pdf[list(FEATURES)].to_numpy(float)
        price, minute = pdf["price"].to_numpy(float), pdf["_minute"].to_numpy()
        chosen = json.loads(pdf["_hps"].iloc[0]) if pdf["_hps"].iloc[0] else settings
        state = ForecastLoop(loop, len(FEATURES), chosen)
        first = min(loop.init_rows, max(len(pdf) - loop.horizon_min - 1, 0))
        if first:
            state.learn_block(minute[:first], price[:first], x[:first], pdf[target].to_numpy(float)[:first])
        made = (state.step(int(minute[i]), float(price[i]), x[i]) for i in range(first, len(pdf)))
        return forecast_frame(key[0], [f for f in made if f is not None])

    if tuned is not None:
        hps = tuned.select(layout.key, F.to_json("hps").alias("_hps"))
        rows = rows.join(per_series(hps, "tuned"), layout.key, "left")
    else:
        rows = rows.withColumn("_hps", F.lit(None).cast("string"))
    needed = rows.select(layout.key, "gi", "_minute", "_hps", *FEATURES, target)
    return needed.groupBy(layout.key).applyInPandas(run, FORECAST_SCHEMA)


@dataclass(frozen=True)
class Folds:
    """``count`` expanding folds of n // (count+1) rows, or one fold starting at ``first`` rows."""

    count: int = 3
    first: int | None = None

    def numbers(self) -> Sequence[int]:
        return range(1, self.count + 1) if self.first is None else (1,)

    def columns(self, fold: int, n: Column) -> tuple[Column, Column]:
        """First forecast row and the row after the last, given the number of rows."""
        if self.first is not None:
            return F.lit(self.first), n
        step = F.floor(n / F.lit(self.count + 1))
        return fold * step, (fold + 1) * step


# Rows that the light calibration reads and scores.
LIGHT_SOURCE = 8000
LIGHT_ROWS = 2500
# Row numbers that are ranked together.
CELL = 100_000
FULL = Folds()
LIGHT = Folds(first=300)


def positions(rows: DataFrame, key: str, by: str) -> DataFrame:
    """``pos``: the rank from 0 of each row of its ``key`` by the number ``by``.

    Ranks within cells of CELL numbers and the counts of earlier cells: no window holds a whole key.
    """
    celled = rows.withColumn("_cell", F.floor(F.col(by) / CELL))
    counts = celled.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(by)) - 1
    ranked = celled.withColumn("_own", own).join(starts, [key, "_cell"])
    return ranked.withColumn("pos", F.col("_start") + F.col("_own")).drop("_cell", "_own", "_start")


def walk_forward(
    features: DataFrame,
    grid: Sequence[Mapping] = GRID,
    folds: Folds = FULL,
    min_rows: int = 1500,
    max_rows: int | None = None,
    target_offset: int = 0,
    spec: FeatureSpec = ONE_MINUTE,
    key: str = "symbol",
    columns: Sequence[str] = FEATURES,
    learn_first: bool = False,
) -> DataFrame:
    """Mean absolute error of the averaged members per (symbol, setting, fold), over all rows.

    A row is forecast before it is learnt and compared with its own target; ``target_offset=1`` compares with
    the target of the row after instead, ``learn_first`` learns it before its forecast. ``max_rows`` takes the
    newest rows only, for calibrations that are defined so.

    A row goes to the folds that read it, once each. A (symbol, fold) is one group whose rows stream through in
    order: what it holds is a batch and the weights of all settings and members. A fold's first part comes twice, for
    the scaler and then to be learnt, so that the sums have one order on every run: a member whose steps are
    too long for its inputs turns the last bit of a mean into another forecast.
    """
    names, target = list(columns), spec.target
    settings, limit = [dict(g) for g in grid], spec.target_clip
    finite_x = [F.coalesce(F.when(F.abs(F.col(c)) < float("inf"), F.col(c)), F.lit(0.0)).cast("double").alias(c) for c in names]
    ranked = positions(features.select(key, "gi", *finite_x, F.col(target).cast("double").alias("_y")), key, "gi")
    totals = per_series(features.groupBy(key).agg(F.count(F.lit(1)).alias("_all")), "walk-rows").where(F.col("_all") >= min_rows)
    n = F.col("_all") if max_rows is None else F.least(F.col("_all"), F.lit(max_rows))
    place = ranked.join(totals, key).withColumn("_n", n).withColumn("pos", F.col("pos") - (F.col("_all") - F.col("_n"))).where("pos >= 0")
    bounds = [F.struct(F.lit(f).alias("fold"), *(x.cast("long").alias(c) for x, c in zip(folds.columns(f, F.col("_n")), ("split", "end"), strict=True))) for f in folds.numbers()]
    spread = place.withColumn("_f", F.explode(F.array(*bounds))).select(key, "_f.*", "pos", *names, "_y").where("pos < end")
    # The first part comes twice: once for the scaler, once to be learnt with it.
    turns = F.when(F.col("pos") < F.col("split"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    twice = spread.withColumn("turn", F.explode(turns))
    ordered = twice.repartition(key, "fold").sortWithinPartitions(key, "fold", "turn", "pos")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        panel = Panel(settings, len(names))
        last = (0, -1)
        waiting = None  # the forecasts of a row that are compared with the next target
        error, scored = np.zeros(len(settings)), 0
        line = np.array([s for s, _ in panel.lines])
        members = np.bincount(line, minlength=len(settings))
        symbol = fold = None
        for pdf in frames:
            symbol, fold = pdf[key].iloc[0], pdf["fold"].iloc[0]
            x, y = pdf[names].to_numpy(float), pdf["_y"].to_numpy(float)
            for i, (turn, pos, split) in enumerate(zip(*(pdf[c].tolist() for c in ("turn", "pos", "split")), strict=True)):
                if (turn, pos) <= last:
                    raise ValueError("rows of a group are not in order")
                last = (turn, pos)
                if turn == 0:
                    panel.observe(x[i])
                elif pos < split:
                    panel.learn(panel.scaled(x[i]), y[i])
                else:
                    if learn_first:
                        panel.update(x[i], y[i])
                    made = np.clip(panel.predict(x[i]), -limit, limit)
                    made = np.bincount(line, made, len(settings)) / members
                    if not learn_first:
                        panel.update(x[i], y[i])
                    if target_offset:
                        made, waiting = waiting, made
                    if made is not None:
                        error += np.abs(made - y[i])
                        scored += 1
        if scored:
            yield pd.DataFrame({"symbol": symbol, "hp_id": np.arange(len(settings)), "fold": fold, "mae": error / scored})

    return ordered.groupBy(key, "fold").applyInPandas(run, "symbol string, hp_id int, fold int, mae double")


def grid_winner(fold_errors: DataFrame) -> DataFrame:
    """The setting with the smallest mean error over folds; the first one wins a tie."""
    mean = fold_errors.groupBy("symbol", "hp_id").agg(F.avg("mae").alias("mae"))
    return mean.groupBy("symbol").agg(
        F.min_by("hp_id", F.struct("mae", "hp_id")).alias("hp_id"), F.min("mae").alias("mae")
    )


def published(winner: DataFrame, grid: Sequence[Mapping] = GRID, horizon: int = 1) -> DataFrame:
    """The winner's settings and error as metadata rows (key, value, updated_at) per symbol; each horizon has a key of its own."""
    options = F.array(*[F.from_json(F.lit(json.dumps(g)), HYPERPARAMETERS) for g in grid])
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    state = F.struct(F.element_at(options, F.col("hp_id") + 1).alias("hps"), stamp.alias("tuned_at"), F.col("mae").alias("mae"))
    return meta_from(winner, _keyed(STATE_KEYS[horizon]), state)


def tuned_settings(meta: DataFrame, horizon: int = 1) -> DataFrame:
    """The newest published settings as (symbol, hps, mae); values that are no settings are left out."""
    found = _stored(meta, STATE_KEYS[horizon], STATE_JSON)
    return found.select("symbol", "decoded.hps", "decoded.mae").where(F.col("hps.pa").isNotNull())


def error_averages(weighted: DataFrame, horizon: int = 1, order: str = "target") -> DataFrame:
    """Metadata rows with each symbol's newest error averages (columns mae_<member> of ``evaluate.member_weights``)."""
    last = weighted.groupBy("symbol").agg(*[F.max_by(f"mae_{m}", order).alias(m) for m in MEMBERS])
    return meta_from(last, _keyed(ERROR_KEYS[horizon]), F.struct(*MEMBERS))


def stored_averages(meta: DataFrame, horizon: int = 1) -> DataFrame:
    """The newest stored averages as (symbol, one column per member); values that are no such JSON are left out."""
    found = _stored(meta, ERROR_KEYS[horizon], ERRORS_JSON)
    return found.select("symbol", *[F.col(f"decoded.{m}").alias(m) for m in MEMBERS]).where(F.coalesce(*MEMBERS).isNotNull())


def _keyed(key: str) -> Column:
    return F.concat("symbol", F.lit(f":{key}"))


def _stored(meta: DataFrame, key: str, schema: str) -> DataFrame:
    found = meta_decoded(meta.where(F.col("key").endswith(f":{key}")), schema)
    return found.withColumn("symbol", F.regexp_extract("key", "^(.*):", 1))


def calibrate(ticks: DataFrame, layout: Layout = Layout(), light: bool = False) -> DataFrame:
    """Walk-forward errors and the winner per symbol, over all rows.

    The light calibration tries fewer settings on the newest LIGHT_ROWS rows of the features of the newest
    LIGHT_SOURCE rows, and learns a row before it is forecast: that is what it is.
    """
    if not light:
        return grid_winner(walk_forward(feature_matrix(ticks, ONE_MINUTE, layout)))
    features = feature_matrix(ticks, ONE_MINUTE, layout, limit=LIGHT_SOURCE)
    return grid_winner(walk_forward(features, GRID[:3], LIGHT, min_rows=400, max_rows=LIGHT_ROWS, learn_first=True))
