"""The daily feature table: indicators of the close, volume score, events, sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide import schemas
from pricetide.functions import scalars as S
from pricetide.operators import indicators as I
from pricetide.operators.sentiment import with_daily_sentiment, with_event_flags
from pricetide.operators.series import Ema, Layout, ema, home_rows, series, span_alpha
from pricetide.operators.stats import zscore
from pricetide.sources.readers import read_if_exists, require_columns
from pricetide.sources.tables import latest, read_log
from pricetide.sources.versions import read_version, replace_table

REQUIRED = ("d", "open", "high", "low", "close", "volume")
KINDS = ("halving", "fork")
# A cell of 1440 days holds at most 1440 rows of a symbol.
LAYOUT = Layout(order=("d",), cell_seconds=86400 * 1440)

# Window lengths of the daily indicators.
SMA_ROWS = (7, 30)
EMA_ROWS = (7, 30)
VOLATILITY_ROWS = 7
INDICATORS = (
    "return_pct",
    "return_log",
    *(f"sma_{n}" for n in SMA_ROWS),
    *(f"ema_{n}" for n in EMA_ROWS),
    "rsi_14",
    "macd",
    "macd_s",
    "macd_h",
    "bbl",
    "bbm",
    "bbu",
    "volatilidade_7d",
)


def look_back(layout: Layout = LAYOUT) -> int:
    """Rows before a row that its indicators depend on, to double precision."""
    alphas = [span_alpha(n) for n in (*EMA_ROWS, *I.MACD_SPANS)] + [1.0 / I.RSI_WINDOW]
    return I.look_back(alphas, max(SMA_ROWS), layout)


def daily_indicators(daily: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Indicators of the close. Each is NULL until its window is full."""
    fast, slow, signal = I.MACD_SPANS
    df, cut = series(daily, layout, back=look_back(layout))
    df = I.gain_loss_from(df.withColumn("_prev", I.lag(cut, "close")), "close", "_prev")
    scans = {f"_ema{n}": Ema("close", span_alpha(n)) for n in EMA_ROWS}
    scans |= {"_fast": Ema("close", span_alpha(fast)), "_slow": Ema("close", span_alpha(slow))}
    scans |= I.rsi_scans()
    df = I.macd_from(ema(df, cut, scans), cut, "_fast", "_slow", signal)
    band, k = I.BOLLINGER
    rolling = {f"sma_{n}": ("mean", "close", n) for n in SMA_ROWS}
    rolling |= {"bbm": ("mean", "close", band), "_sd": ("std_pop", "close", band)}
    rolling |= {"volatilidade_7d": ("std", "close", VOLATILITY_ROWS)}
    df = I.with_rolling(df, cut, rolling)

    def from_row(n: int, x: str):
        return F.when(F.col("gi") >= n - 1, F.col(x))

    strength = F.when(F.col("down") == 0, F.lit(100.0)).otherwise(
        100.0 - 100.0 / (1.0 + F.try_divide("up", "down"))
    )
    df = df.withColumns(
        {
            "return_pct": (F.try_divide("close", "_prev") - 1.0) * 100.0,
            "return_log": S.log_ratio("close", "_prev"),
            **{f"ema_{n}": from_row(n, f"_ema{n}") for n in EMA_ROWS},
            "rsi_14": F.when(F.col("gi") >= I.RSI_WINDOW - 1, strength),
            "macd_s": from_row(slow + signal - 1, "macd_signal"),
            "macd_h": from_row(slow + signal - 1, "macd_hist"),
            "macd": from_row(slow, "macd"),
            "bbl": F.col("bbm") - k * F.col("_sd"),
            "bbu": F.col("bbm") + k * F.col("_sd"),
        }
    )
    return home_rows(df).select(*daily.columns, "gi", *INDICATORS)


def daily_features(
    daily: DataFrame, calendar: DataFrame, sentiment: DataFrame, layout: Layout = LAYOUT
) -> DataFrame:
    """Complete rows of the feature table.

    Rows of ``calendar`` and ``sentiment`` count for the symbol they name as ``ativo``; both tables may be empty,
    the columns stay.
    """
    require_columns(daily, REQUIRED)
    clean = daily.select(layout.key, *REQUIRED).dropna("any")
    return completed(daily_indicators(clean, layout), calendar, sentiment, layout)


def completed(indicators: DataFrame, calendar: DataFrame, sentiment: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Rows of ``daily_indicators`` with the volume score, event flags and sentiment; rows with anything missing go."""
    df = zscore(indicators, "volume", "volume_norm", layout.key)
    df = with_daily_sentiment(with_event_flags(df, calendar, "d", KINDS, layout.key), sentiment, "d", layout.key)
    return df.drop("gi").dropna("any")


HISTORY = T.StructType([*schemas.DAILY, T.StructField("year", T.IntegerType())])
FEATURE_COLUMNS = ("symbol", *REQUIRED, *INDICATORS, "volume_norm", *(f"evento_{k}" for k in KINDS), "media_sentimento")
_KINDS = {"symbol": T.StringType(), "d": T.DateType()} | {f"evento_{k}": T.IntegerType() for k in KINDS}
FEATURE_TABLE = T.StructType([T.StructField(c, _KINDS.get(c, T.DoubleType())) for c in FEATURE_COLUMNS])


def daily_job(
    spark: SparkSession, history_path: str, calendar_path: str, means_path: str, out_path: str, asset: str | None = None, layout: Layout = LAYOUT
) -> int:
    """The feature table of one asset, or of all, computed from the stored tables and published; its version.

    The history is the current version of its table (``tables.write_history``). The calendar and the log of day means may
    be absent; both are cut to the asset in the scan. Days of another asset than ``asset`` are neither read nor in the result.
    """
    only = lambda column: None if asset is None else F.col(column) == asset
    history = read_version(spark, history_path, HISTORY, condition=only("symbol"))
    calendar = read_if_exists(spark, calendar_path, schemas.CALENDAR, only("ativo"))
    log = read_log(spark, means_path, schemas.SENTIMENT)
    means = latest(log if asset is None else log.where(only("ativo")), ["ativo", "data"])
    features = daily_features(history.select("symbol", *REQUIRED), calendar, means, layout)
    return replace_table(features.select(*FEATURE_COLUMNS), out_path, unique=["symbol", "d"])


def read_features(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The daily feature table as it was last published, or as a version of it."""
    return read_version(spark, path, FEATURE_TABLE, version)
