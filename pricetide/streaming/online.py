"""The forecasting loop as a stateful stream: bars in, forecasts out, one state per symbol."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricetide.operators.learners import DEFAULTS
from pricetide.operators.online import ForecastLoop, LoopSpec, check_block
from pricetide.operators.series import Layout, tail_rows
from pricetide.plans.features import FEATURES, FeatureSpec
from pricetide.plans.forecast import FORECAST_SCHEMA, forecast_frame
from pricetide.session import STATE_STORE
from pricetide.streaming.incremental import FeatureState

BAR_COLUMNS = ("price", "open", "volume", "return_pct")


def as_text(features: FeatureState, loop: ForecastLoop) -> str:
    return json.dumps({"features": features.dump(), "loop": loop.dump()})


def _in_order(bars: pd.DataFrame) -> Iterator[tuple[int, list[float]]]:
    bars = bars.sort_values("minute")
    seconds = bars["minute"].astype("datetime64[us]").astype("int64") // 1_000_000
    for second, row in zip(seconds, bars[list(BAR_COLUMNS)].itertuples(index=False, name=None)):
        yield int(second), [float(v) for v in row]


def advance(features: FeatureState, loop: ForecastLoop, bars: pd.DataFrame) -> list[dict]:
    """Take bars in time order; those not newer than the last one taken are skipped."""
    made = []
    for second, row in _in_order(bars):
        if second > loop.last_minute:
            made.append(loop.step(second, row[0], features.push(second, *row)))
    return [f for f in made if f is not None]


def initial_states(
    bars: DataFrame,
    loop: LoopSpec,
    features: FeatureSpec,
    layout: Layout,
    settings: Mapping[str, Mapping[str, float]] = DEFAULTS,
) -> DataFrame:
    """The state of every symbol after its newest ``max_rows`` bars, as (symbol, value).

    The first ``init_rows`` bars are learnt as a block, the others one by one as the stream does.
    """
    check_block(loop)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, model = FeatureState(features), ForecastLoop(loop, len(FEATURES), settings)
        rows = list(_in_order(pdf))
        first = min(loop.init_rows, max(len(rows) - loop.horizon_min - 1, 0))
        x = np.array([state.push(second, *row) for second, row in rows[:first]])
        price = np.array([row[0] for _, row in rows])
        if first:
            later = price[loop.horizon_min : first + loop.horizon_min]
            labels = np.clip(later / price[:first] - 1.0, -loop.ret_clip, loop.ret_clip)
            model.learn_block([second for second, _ in rows[:first]], price[:first], x, labels)
        for second, row in rows[first:]:
            model.step(second, row[0], state.push(second, *row))
        return pd.DataFrame({"symbol": [key[0]], "value": [as_text(state, model)]})

    newest = tail_rows(bars.select("symbol", "minute", *BAR_COLUMNS), layout, loop.max_rows)
    return newest.groupBy("symbol").applyInPandas(run, "symbol string, value string")


class ForecastProcessor(StatefulProcessor):
    """Keeps the feature state and the loop of one symbol as one text value.

    Bars of a batch are taken in time order; a bar not newer than the last one is left to the batch
    rebuild. The labels still awaited are part of the state and never older than one horizon.
    """

    def __init__(self, loop: LoopSpec, features: FeatureSpec, settings: Mapping[str, Mapping[str, float]]):
        self.loop, self.features, self.settings = loop, features, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("loop", "value string")

    def _restore(self) -> tuple[FeatureState, ForecastLoop]:
        features = FeatureState(self.features)
        loop = ForecastLoop(self.loop, len(FEATURES), self.settings)
        if self.saved.exists():
            state = json.loads(self.saved.get()[0])
            features.load(state["features"])
            loop.load(state["loop"])
        return features, loop

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        features, loop = self._restore()
        made = advance(features, loop, pd.concat(list(rows)))
        self.saved.update((as_text(features, loop),))
        yield forecast_frame(key[0], made)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.saved.update((initialState["value"].iloc[0],))

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def forecast_stream(
    bars: DataFrame,
    loop: LoopSpec,
    features: FeatureSpec,
    settings: Mapping[str, Mapping[str, float]] = DEFAULTS,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Forecasts for a stream of bars (symbol, minute, price, open, volume, return_pct).

    ``initial`` (see ``initial_states``) starts the symbols it names from their history. After that
    the checkpoint holds everything, weights included, so a restart goes on where it stopped.
    """
    use_state_store(bars.sparkSession)
    return bars.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=ForecastProcessor(loop, features, settings),
        outputStructType=FORECAST_SCHEMA,
        outputMode="Append",
        timeMode="None",
        initialState=initial.groupBy("symbol") if initial is not None else None,
    )
