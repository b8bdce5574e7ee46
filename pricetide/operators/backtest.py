"""Paper trading of forecasts: positions, costs, equity, drawdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.evaluate import recent
from pricetide.operators.series import Layout, home_rows, join_runs, running_product, series
from pricetide.session import stage

LAYOUT = Layout(order=("target",))


def backtest(
    rows: DataFrame,
    layout: Layout = LAYOUT,
    threshold_bps: float = 5.0,
    fee_bps: float = 4.0,
    hours: int | None = None,
) -> DataFrame:
    """The equity curve of going long while the forecast return exceeds the threshold.

    The position of a row is the signal of the row before. The fee is charged on every change of the
    signal, also when it falls; the first row has no earlier signal and is free. A row whose price
    has not arrived counts as return 0. Returns above -100 % are assumed, so equity stays positive.
    """
    if hours is not None:
        rows = recent(rows, hours, layout)
    rows = rows.select("symbol", *layout.order, "y_hat_ret", "price_real")
    rows = rows.withColumn(
        "signal", F.coalesce((F.col("y_hat_ret") > threshold_bps / 10000.0).cast("int"), F.lit(0))
    )
    df, cut = series(rows, layout, back=1)
    df = df.withColumns(
        {
            "_real": F.lag("price_real").over(cut.rows()),
            "_signal": F.lag("signal").over(cut.rows()),
        }
    )
    df = df.withColumn(
        "ret_real", F.coalesce(F.try_divide("price_real", "_real") - 1.0, F.lit(0.0))
    )
    gain = F.coalesce("_signal", F.lit(0)) * F.col("ret_real")
    cost = F.coalesce(F.abs(F.col("signal") - F.col("_signal")), F.lit(0)) * (fee_bps / 10000.0)
    df = df.withColumn("ret_model", gain - cost)
    df = _with_equity(df, cut)
    peak = F.max(F.when(F.col("home"), F.col("eq_model"))).over(cut.upto())
    df = df.withColumn("peak", F.greatest("_peak_in", peak))
    df = df.withColumn("drawdown", (F.col("eq_model") - F.col("peak")) / F.col("peak"))
    return home_rows(df).drop("_real", "_signal", "_model_in", "_hold_in", "_peak_in")


def _with_equity(df: DataFrame, cut: Layout) -> DataFrame:
    """Running products over the whole series, and the highest equity of all earlier runs."""
    key = cut.key
    model, hold = 1.0 + F.col("ret_model"), 1.0 + F.col("ret_real")
    own = df.withColumn("_run", F.product(F.when(F.col("home"), model)).over(cut.upto()))
    totals = own.groupBy(key, "chunk").agg(
        F.product(F.when(F.col("home"), model)).alias("_model"),
        F.product(F.when(F.col("home"), hold)).alias("_hold"),
        F.max(F.when(F.col("home"), F.col("_run"))).alias("_top"),
    )
    # A row for each run, read several times below.
    totals = stage(totals, "equity-runs")
    # Equity and its peak relative to the start of a group of runs, then what the groups before amount to.
    grouped = totals.withColumn("_group", F.floor(F.col("chunk") / cut.group_rows))
    inside = Window.partitionBy(key, "_group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    one = F.lit(1.0)
    grouped = grouped.withColumns({f"_i{c}": F.coalesce(F.product(c).over(inside), one) for c in ("_model", "_hold")})
    reached = F.col("_i_model") * F.col("_top")
    groups = grouped.groupBy(key, "_group").agg(F.product("_model").alias("_gm"), F.product("_hold").alias("_gh"), F.max(reached).alias("_gt"))
    groups = groups.withColumns({"_cm": F.coalesce(F.product("_gm").over(before), one), "_ch": F.coalesce(F.product("_gh").over(before), one)})
    groups = groups.withColumn("_ct", F.max(F.col("_cm") * F.col("_gt")).over(before)).select(key, "_group", "_cm", "_ch", "_ct")
    carried = grouped.withColumn("_it", F.max(reached).over(inside)).join(groups, [key, "_group"])
    carried = carried.withColumns(
        {
            "_model_in": F.col("_cm") * F.col("_i_model"),
            "_hold_in": F.col("_ch") * F.col("_i_hold"),
            "_peak_in": F.greatest("_ct", F.col("_cm") * F.col("_it")),
        }
    )
    df = join_runs(df, cut, carried.select(key, "chunk", "_model_in", "_hold_in", "_peak_in"))
    return df.withColumns(
        {
            "eq_model": running_product(cut, model, "_model_in"),
            "eq_hold": running_product(cut, hold, "_hold_in"),
        }
    )


def summary(curve: DataFrame, order: str = "target") -> DataFrame:
    """Total return of the strategy and of holding, and the deepest drawdown, per symbol."""
    return curve.groupBy("symbol").agg(
        (F.max_by("eq_model", order) - 1.0).alias("total_model"),
        (F.max_by("eq_hold", order) - 1.0).alias("total_hold"),
        F.min("drawdown").alias("max_drawdown"),
    )
