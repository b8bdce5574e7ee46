"""Forecasts against the prices that arrived: row measures, figures, alerts, member weights."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import scalars as S
from pricetide.operators.series import Ema, Layout, carry_in, ema, filled, halo_rows, home_rows, per_series, series, tail_rows
from pricetide.schemas import MEMBERS


def evaluated(preds: DataFrame, bars: DataFrame, anchor: str = "baseline") -> DataFrame:
    """Each forecast with the price of its target minute and its error measures.

    ``bars`` holds one row per (symbol, minute), so the left join keeps one row per forecast.
    Measures stay NULL until the price is there.
    """
    actual = bars.select("symbol", F.col("minute").alias("target"), F.col("price").alias("price_real"))
    return with_errors(preds.join(actual, ["symbol", "target"], "left"), anchor)


def with_errors(df: DataFrame, anchor: str = "baseline") -> DataFrame:
    y, real, base = F.col("y_hat"), F.col("price_real"), F.col("baseline")
    df = df.withColumns({"erro": y - real, "erro_base": base - real})
    return df.withColumns(
        {
            "acerto_dir": S.same_direction(y, real, F.col(anchor)),
            "melhor_que_base": (F.abs("erro") < F.abs("erro_base")).cast("double"),
        }
    )


def with_anchor(df: DataFrame, layout: Layout, horizon: int = 10) -> DataFrame:
    """Add ``price_t``, the price at forecast time: itself, ``close_t``, or ``close`` some rows back."""
    if "price_t" in df.columns:
        return df
    if "close_t" in df.columns:
        return df.withColumn("price_t", F.col("close_t"))
    if "close" in df.columns:
        rows, cut = series(df, layout, back=horizon)
        rows = rows.withColumn("price_t", F.lag("close", horizon).over(cut.rows()))
        return home_rows(rows).drop("gi")
    return df.withColumn("price_t", F.lit(None).cast("double"))


def mae(error: str = "erro") -> Column:
    return F.avg(F.abs(error))


def mape(actual: str = "price_real", forecast: str = "y_hat") -> Column:
    """Mean absolute percentage error; rows without an actual or with an actual of 0 do not count."""
    a, b = F.col(actual), F.col(forecast)
    return F.avg(F.abs(F.try_divide(a - b, a))) * 100.0


def rmse(actual: str = "price_real", forecast: str = "y_hat") -> Column:
    d = F.col(actual) - F.col(forecast)
    return F.sqrt(F.avg(d * d))


def kpis(rows: DataFrame) -> DataFrame:
    """All figures of each symbol in one aggregation."""
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        mae().alias("mae"),
        mape().alias("mape"),
        rmse().alias("rmse"),
        (100.0 * F.avg("acerto_dir")).alias("acc_dir"),
        (100.0 * F.avg("melhor_que_base")).alias("beat_base"),
        F.count_if(F.col("price_real").isNull()).alias("pending"),
    )


def recent(rows: DataFrame, hours: int, layout: Layout) -> DataFrame:
    """The newest hours*60 rows of every symbol."""
    return tail_rows(rows, layout, hours * 60)


def pending(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(F.count_if(F.col("price_real").isNull()).alias("pending"))


def latest_values(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Newest price and newest non-NULL forecast per symbol, plain and as money text."""
    last_price = bars.groupBy("symbol").agg(F.max_by("price", "minute").alias("last_price"))
    known = F.when(F.col("y_hat").isNotNull(), F.col("target"))
    last_pred = rows.groupBy("symbol").agg(F.max_by("y_hat", known).alias("last_pred"))
    both = last_price.join(last_pred, "symbol", "full")
    return both.withColumns(
        {"last_price_text": S.money("last_price"), "last_pred_text": S.money("last_pred")}
    )


def bands(rows: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation per symbol, and the band one deviation around the mean."""
    return (
        rows.groupBy("symbol")
        .agg(F.avg(column).alias("mu"), F.stddev_pop(column).alias("sigma"))
        .withColumns({"upper": F.col("mu") + F.col("sigma"), "lower": F.col("mu") - F.col("sigma")})
    )


def error_limit(prices: DataFrame, layout: Layout, n: int = 300, factor: float = 0.5) -> DataFrame:
    """Default alert limit: half the population deviation of the newest prices."""
    last = tail_rows(prices, layout, n)
    return last.groupBy("symbol").agg((F.stddev_pop("price") * factor).alias("err_limit"))


def alerts(
    rows: DataFrame, limits: DataFrame, min_accuracy: float = 50.0, window_min: int | None = None
) -> DataFrame:
    """``error`` above the error limit, else ``warn`` below the accuracy limit, else ``ok``.

    ``window_min`` looks at the minutes before the newest target only; None takes every row.
    """
    if window_min is not None:
        newest = rows.groupBy("symbol").agg(F.max("target").alias("_newest"))
        start = F.col("_newest") - F.make_dt_interval(mins=F.lit(window_min))
        rows = rows.join(per_series(newest, "newest"), "symbol").where(F.col("target") > start)
    figures = rows.groupBy("symbol").agg(mae().alias("mae"), (100.0 * F.avg("acerto_dir")).alias("acc_dir"))
    state = (
        F.when(F.col("mae") > F.col("err_limit"), "error")
        .when(F.col("acc_dir") < min_accuracy, "warn")
        .otherwise("ok")
    )
    return figures.join(limits, "symbol", "left").withColumn("state", state)


def heatmap(rows: DataFrame) -> DataFrame:
    """Mean direction hit in percent per weekday (rows) and hour (columns ``h0``..``h23``)."""
    hits = rows.where(F.col("acerto_dir").isNotNull())
    hits = hits.withColumns({"dia": F.date_format("target", "EEEE"), "hora": F.hour("target")})
    table = hits.groupBy("symbol", "dia").pivot("hora", list(range(24))).agg(F.avg("acerto_dir"))
    percent = [F.bround(F.col(str(h)) * 100.0, 1).alias(f"h{h}") for h in range(24)]
    return table.select("symbol", "dia", *percent)


def member_errors(rows: DataFrame) -> DataFrame:
    """Absolute error of each member on the forecasts whose price has arrived."""
    done = rows.where(F.col("price_real").isNotNull())
    return done.withColumns({f"err_{m}": F.abs(F.col("price_real") - F.col(f"y_hat_{m}")) for m in MEMBERS})


def member_weights(
    rows: DataFrame,
    layout: Layout = Layout(order=("target",)),
    alpha: float = 0.2,
    seed: float = 0.01,
    eps: float = 1e-6,
    after_update: bool = True,
) -> DataFrame:
    """Exponential mean of each member's error and the weights 1/(mean+eps), adding up to 1.

    With ``after_update=False`` a row carries the weights before its own error was known, which is
    what the forecast made at that moment used.
    """
    errors = member_errors(rows)
    key, order = layout.key, list(layout.order)
    # A member's average moves only when that member has an error, so each runs over rows of its own.
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("_member"), F.col(f"err_{m}").alias("_err")) for m in MEMBERS]))
    single = errors.select(key, *order, each.alias("_e")).select(
        F.concat_ws("\x01", key, "_e._member").alias("_line"), F.col(key), F.col("_e._member").alias("_member"), *order, F.col("_e._err").alias("_err")
    )
    own = replace(layout, key="_line")
    df, cut = series(single.where(F.col("_err").isNotNull()), own, back=max(halo_rows([alpha], layout.sub_rows), 1))
    df = home_rows(ema(df, cut, {"_mean": Ema("_err", alpha, seed=seed)}))
    means = df.groupBy(key, *order).pivot("_member", list(MEMBERS)).agg(F.first("_mean"))
    # Rows where a member has no error carry its newest mean; rows equal in key and order share it.
    joined = errors.join(means.withColumnsRenamed({m: f"_mean_{m}" for m in MEMBERS}), [key, *order], "left")
    df, cut = series(joined, layout, back=1)
    df = carry_in(df, cut, {f"_before_{m}": ("last", F.col(f"_mean_{m}")) for m in MEMBERS})
    latest = {f"mae_{m}": filled(cut, F.col(f"_mean_{m}"), f"_before_{m}") for m in MEMBERS}
    df = df.withColumns({name: F.coalesce(value, F.lit(seed)) for name, value in latest.items()})
    if not after_update:
        df = df.withColumns({f"_was_{m}": F.lag(f"mae_{m}").over(cut.rows()) for m in MEMBERS})
        df = df.withColumns({f"mae_{m}": F.coalesce(f"_was_{m}", F.lit(seed)) for m in MEMBERS})
    kept = home_rows(df).select(*errors.columns, "gi", *[f"mae_{m}" for m in MEMBERS])
    return weights_from(kept, eps)


def weights_from(df: DataFrame, eps: float) -> DataFrame:
    inverse = {m: 1.0 / (F.col(f"mae_{m}") + eps) for m in MEMBERS}
    total = sum(inverse.values(), F.lit(0.0))
    return df.withColumns({f"w_{m}": inverse[m] / total for m in MEMBERS})


def delayed_labels(bars: DataFrame, horizon: str = "30 minutes", limit: float = 0.15) -> DataFrame:
    """Label of a bar: its clipped return to the bar exactly ``horizon`` later, by time.

    A bar whose counterpart is missing gets no label; the older row is matched by equality.
    """
    older = bars.select("symbol", "minute", F.col("price").alias("price_then"))
    later = bars.select(
        "symbol",
        (F.col("minute") - F.expr(f"interval {horizon}")).alias("minute"),
        F.col("minute").alias("label_at"),
        F.col("price").alias("price_now"),
    )
    label = S.bounded_change("price_now", "price_then", limit)
    return older.join(later, ["symbol", "minute"]).withColumn("y_label", label)


def components(rows: DataFrame, layout: Layout = Layout(order=("target",)), n: int = 200) -> DataFrame:
    """The newest ``n`` forecasts of every symbol with members, weights and errors."""
    wanted = ["symbol", "target", "price_real", "y_hat"]
    wanted += [f"y_hat_{m}" for m in MEMBERS] + [f"w_{m}" for m in MEMBERS] + ["erro", "acerto_dir"]
    have = [c for c in wanted if c in rows.columns]
    return tail_rows(rows, layout, n).select(*have)
