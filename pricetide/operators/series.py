"""Ordered-series machinery that never puts a whole series into one task.

A series is all rows of one ``key`` (a symbol) in time order. One symbol may hold a third of a
table, so no window here is partitioned by the symbol alone over data rows. Three steps replace it:

1. ``dense_index`` numbers the rows 0, 1, 2, ... per series. Rows are counted per (symbol, time
   cell), the counts are summed over the cells of a symbol, and rows are numbered inside a cell.
   The per-symbol step only sees groups of cells (``earlier_totals``).
2. ``chunk`` cuts a series into runs of ``chunk_rows`` rows and copies the rows just before (and
   after) a run into it. Lags, rolling windows and leads then look no further than their own run.
3. Unbounded look-back needs one row per run and not the rows: ``carry_in`` totals each run, and groups of
   runs, and hands every run the total of the earlier ones (prefix sum, product, last value). Exponential
   averages do not even need that: their memory fades below double precision inside the copied
   rows, so ``ema`` is exact to rounding with no further shuffle.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pricetide.session import stage

# A term this small relative to the newest one is lost in a double anyway.
FADE = -math.log(1e-18)
# exp of this is still far from the largest double.
MAX_EXPONENT = 600.0
CELL_CHOICES = (86400, 3600, 600, 60, 1)
# The column of a row's time cell. A table stored by (symbol, cell) has it already.
CELL = "_cell"


@dataclass(frozen=True)
class Layout:
    """How a series is cut: ``chunk_rows`` per task, ``sub_rows`` per closed-form block.

    640 rows let an average of span 30 fade out, so one block of copies in front of a run suffices
    (4 % more rows at the default size). Runs and time cells of a symbol are totalled by two levels, ``group_rows``
    of them to a group: a symbol of 3.3e11 rows has 20 million runs in 4,800 groups.
    ``cell_seconds`` should make a cell hold thousands to a few million rows of the busiest symbol:
    days for minute bars (see ``plans.features.layout_for``), seconds for a very dense feed.
    """

    key: str = "symbol"
    order: tuple[str, ...] = ("ts", "seq")
    cell_seconds: int = 600
    chunk_rows: int = 16640
    sub_rows: int = 640
    group_rows: int = 4096
    back: int = 0
    ahead: int = 0

    def rows(self) -> WindowSpec:
        """All rows of a run in series order."""
        return self._rows

    def upto(self) -> WindowSpec:
        return self._upto

    def last(self, n: int) -> WindowSpec:
        return self._rows.rowsBetween(-(n - 1), Window.currentRow)

    def in_sub(self) -> WindowSpec:
        return self._in_sub

    # Built once per layout: every spec costs several calls into the JVM.
    @cached_property
    def _rows(self) -> WindowSpec:
        return Window.partitionBy(self.key, "chunk").orderBy("sub", "gi")

    @cached_property
    def _upto(self) -> WindowSpec:
        return self._rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @cached_property
    def _in_sub(self) -> WindowSpec:
        whole = Window.partitionBy(self.key, "chunk", "sub").orderBy("gi")
        return whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _cell(layout: Layout) -> Column:
    seconds = F.unix_seconds(F.col(layout.order[0]).cast("timestamp"))
    return F.floor(seconds / layout.cell_seconds).cast("bigint")


def with_cell(df: DataFrame, layout: Layout) -> DataFrame:
    """Add the time cell unless the rows have it."""
    return df if CELL in df.columns else df.withColumn(CELL, _cell(layout))


def pick_cell_seconds(df: DataFrame, layout: Layout, max_rows: int = 2_000_000) -> int:
    """The widest time cell whose fullest cell stays below ``max_rows``.

    One narrow counting pass per width tried; for callers that do not know how dense a feed is.
    """
    for width in CELL_CHOICES:
        cell = _cell(replace(layout, cell_seconds=width)).alias("_cell")
        counts = df.groupBy(F.col(layout.key), cell).agg(F.count(F.lit(1)).alias("_n"))
        fullest = counts.agg(F.max("_n")).first()[0] or 0
        if fullest <= max_rows:
            return width
    return CELL_CHOICES[-1]


def dense_index(df: DataFrame, layout: Layout, previous: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``gi``: the 0-based position of each row in its series.

    ``previous`` (name -> column) also adds the value of the row before, so that what is added up over a series can be totalled
    before the rows are dealt to runs. The first row of a cell takes it from the last one of the cells before.
    """
    key, previous = layout.key, dict(previous or {})
    celled = with_cell(df, layout)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if previous:
        aggs.append(F.max_by(F.struct(*[F.col(c).alias(name) for name, c in previous.items()]), F.struct(*layout.order)).alias("_last"))
    counts = celled.groupBy(key, "_cell").agg(*aggs)
    totals = {"_off": ("sum", F.col("_n"))} | ({"_from": ("last", F.col("_last"))} if previous else {})
    offsets = earlier_totals(counts, key, "_cell", totals, layout.group_rows).select(key, "_cell", *totals)
    in_cell = Window.partitionBy(key, "_cell").orderBy(*layout.order)
    own = {"_rn": F.row_number().over(in_cell)} | {f"_own_{name}": F.lag(c).over(in_cell) for name, c in previous.items()}
    joined = celled.withColumns(own).join(offsets, [key, "_cell"]).withColumn("gi", F.col("_off") + F.col("_rn") - 1)
    before = {name: F.when(F.col("_rn") > 1, F.col(f"_own_{name}")).otherwise(F.col(f"_from.{name}")) for name in previous}
    return joined.withColumns(before).drop("_cell", "_rn", "_off", "_from", *[f"_own_{name}" for name in previous])


def halo_rows(alphas: Sequence[float], sub_rows: int) -> int:
    """Rows to copy in front of a run so that these exponential averages are exact there."""
    return max((_fade_subs(a, sub_rows) for a in alphas), default=0) * sub_rows


def _fade_subs(alpha: float, sub_rows: int) -> int:
    if alpha >= 1.0:
        return 0
    return math.ceil(FADE / (sub_rows * -math.log1p(-alpha)))


def _overflows(alpha: float, sub_rows: int) -> bool:
    """Does q**-k leave the range of a double inside one block?"""
    return alpha < 1.0 and sub_rows * -math.log1p(-alpha) > MAX_EXPONENT


def chunk(indexed: DataFrame, layout: Layout, back: int = 0, ahead: int = 0) -> tuple[DataFrame, Layout]:
    """Assign rows to runs and copy the ``back`` rows before and ``ahead`` rows after each run.

    Adds ``chunk``, ``sub`` and ``home`` (true for a run's own rows, false for copies). One shuffle
    by (symbol, chunk) serves every window built from the returned layout.
    """
    sub_rows = layout.sub_rows
    back = math.ceil(back / sub_rows) * sub_rows
    rows = max(layout.chunk_rows, back, ahead)
    rows = math.ceil(rows / sub_rows) * sub_rows
    own = F.expr(f"gi div {rows}")
    pos = F.col("gi") % rows
    enters, leaves = pos >= rows - back, (pos < ahead) & (own > 0)
    targets = F.array(own)
    if ahead:
        targets = F.when(leaves, F.array(own, own - 1)).otherwise(targets)
    if back:
        targets = F.when(enters, F.array(own, own + 1)).otherwise(targets)
    if ahead and back and ahead + back > rows:
        targets = F.when(enters & leaves, F.array(own, own + 1, own - 1)).otherwise(targets)
    out = indexed.withColumn("chunk", F.explode(targets))
    out = out.withColumn("sub", F.expr(f"gi div {sub_rows}")).withColumn(
        "home", F.col("chunk") == own
    )
    # Runs without a row of their own (copies behind the end of a series) vanish with the home filter.
    return out, replace(layout, chunk_rows=rows, back=back, ahead=ahead)


def series(df: DataFrame, layout: Layout, back: int = 0, ahead: int = 0) -> tuple[DataFrame, Layout]:
    """``dense_index`` followed by ``chunk``."""
    return chunk(dense_index(df, layout), layout, back, ahead)


def home_rows(df: DataFrame) -> DataFrame:
    """Drop the copies and the layout columns, keep ``gi``."""
    return df.where("home").drop("chunk", "sub", "home")


@dataclass(frozen=True)
class Ema:
    """One exponential average ``y = alpha*x + (1-alpha)*y'`` over column ``x``.

    ``first`` is the row whose value starts the average (``y = x`` there, NULL before it). With a
    ``seed`` the average starts from that constant before row 0 instead.
    """

    x: str
    alpha: float
    first: int = 0
    seed: float | None = None


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def _powers(q: float, n: int, sign: int = 1) -> Column:
    """The constant array q**0, q**+-1, ..., q**+-n: a lookup where a power per row would be slow."""
    return F.from_json(F.lit(json.dumps([q ** (sign * k) for k in range(n + 1)])), "array<double>")


def _faded(values: Column, q: float) -> Column:
    """Sum of an array, the last element whole and each earlier one q times less."""
    return F.aggregate(values, F.lit(0.0), lambda total, x: total * q + x)


def ema(
    df: DataFrame,
    layout: Layout,
    specs: Mapping[str, Ema],
    alongside: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add one column per spec.

    With q = 1-alpha and k the position in a block, the block's own part is
    ``q**k * sum(u_j * q**-j)``; earlier blocks add ``q**(k+1)`` times their end value, and only as
    many of them count as the fade allows. ``x`` must not be NULL from row ``first`` on.
    An average that forgets so fast that q**-j overflows in a block needs a few dozen rows only, and is
    summed over those directly.
    ``alongside`` are further columns over ``layout.rows()`` that ride in the same window pass.
    """
    size = layout.sub_rows
    k = (F.col("gi") % size).cast("int")
    local, result, short = {}, {}, {}
    for name, s in specs.items():
        q = 1.0 - s.alpha
        x = F.col(s.x)
        if q <= 0.0:
            continue
        u = x * s.alpha
        if s.seed is not None:
            u = F.when(F.col("gi") == s.first, u + q * s.seed).otherwise(u)
        else:
            u = F.when(F.col("gi") == s.first, x).otherwise(u)
        u = F.when(F.col("gi") >= s.first, u).otherwise(F.lit(0.0))
        if _overflows(s.alpha, size):
            newest = F.collect_list(u).over(layout.last(math.ceil(FADE / -math.log1p(-s.alpha)) + 1))
            short[name] = _faded(newest, q)
            continue
        local[f"_sum_{name}"] = F.sum(u * F.get(_powers(q, size, -1), k)).over(layout.in_sub())
    out = df.withColumns(local) if local else df
    powers = {name: _powers(1.0 - s.alpha, size) for name, s in specs.items() if s.alpha < 1.0 and name not in short}
    out = out.withColumns({f"_loc_{name}": F.col(f"_sum_{name}") * F.get(powers[name], k) for name in powers})

    # The end value of the block before is the newest value seen on a block's last row; taking that
    # of the block before as the value, too, goes back block by block.
    reach = {name: _fade_subs(s.alpha, size) if name in powers else 0 for name, s in specs.items()}
    depth = max(reach.values(), default=0)
    is_last = k == size - 1
    before = layout.rows().rowsBetween(Window.unboundedPreceding, -1)
    ends = []
    for m in range(1, max(depth, 1) + 1):
        step = dict(alongside or {}) if m == 1 else {}
        for name in powers:
            if reach[name] >= m:
                source = f"_loc_{name}" if m == 1 else f"_end{m - 1}_{name}"
                step[f"_end{m}_{name}"] = F.last(F.when(is_last, F.col(source)), ignorenulls=True).over(before)
                ends.append(f"_end{m}_{name}")
        out = out.withColumns(step) if step else out
    for name, s in specs.items():
        if name in short:
            result[name] = F.when(F.col("gi") >= s.first, short[name])
            continue
        if name not in powers:
            result[name] = F.when(F.col("gi") >= s.first, F.col(s.x))
            continue
        q = 1.0 - s.alpha
        carried = F.lit(0.0)
        for m in range(1, reach[name] + 1):
            carried = carried + F.coalesce(f"_end{m}_{name}", F.lit(0.0)) * q ** (size * (m - 1))
        value = F.col(f"_loc_{name}") + F.get(powers[name], k + 1) * carried
        result[name] = F.when(F.col("gi") >= s.first, value)
    return out.withColumns(result).drop(*local, *[f"_loc_{n}" for n in powers], *ends)


def _total(kind: str, x: Column, position: Column) -> Column:
    """What rows amount to, as an aggregate."""
    known = F.when(x.isNotNull(), position)
    return {"sum": F.sum, "product": F.product, "max": F.max, "last": lambda x: F.max_by(x, known)}[kind](x)


def _before(kind: str, x: Column, window: WindowSpec) -> Column:
    """What the rows of a window amount to; its rows are in order."""
    if kind == "last":
        return F.last(x, ignorenulls=True).over(window)
    return {"sum": F.sum, "product": F.product, "max": F.max}[kind](x).over(window)


def _joined(kind: str, earlier: Column, later: Column) -> Column:
    """Two totals as one."""
    if kind == "sum":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(later, F.lit(0))
    if kind == "product":
        return F.coalesce(earlier, F.lit(1.0)) * F.coalesce(later, F.lit(1.0))
    return {"max": F.greatest(earlier, later), "last": F.coalesce(later, earlier)}[kind]


def earlier_totals(rows: DataFrame, key: str, position: str, totals: Mapping[str, tuple[str, Column]], group: int) -> DataFrame:
    """Add to every row, per name, what the rows before it in its series amount to: by two levels of windows.

    ``totals`` maps a name to (kind, expression): ``sum`` (0 without rows), ``product`` (1), ``max``, or the ``last``
    value that is not NULL. Rows are grouped by ``position div group``; a window sees the rows of one group, another
    one row for each group of a series, so with g rows to a group neither sees more than g or rows / g. No two rows of
    a series share a position.
    """
    unknown = {kind for kind, _ in totals.values()} - {"sum", "product", "max", "last"}
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    grouped = rows.withColumn("_group", F.floor(F.col(position) / group))
    inside = Window.partitionBy(key, "_group").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    kinds = {name: kind for name, (kind, _) in totals.items()}
    own = grouped.withColumns({f"_i_{name}": _before(kind, x, inside) for name, (kind, x) in totals.items()})
    # A group's total is what stands before its last row, with that row: it needs no other shuffle than the window.
    ends = [F.max_by(_joined(kind, F.col(f"_i_{name}"), x), F.col(position)).alias(f"_g_{name}") for name, (kind, x) in totals.items()]
    whole = own.groupBy(key, "_group").agg(*ends)
    carried = whole.select(key, "_group", *[_before(kind, F.col(f"_g_{name}"), before).alias(f"_c_{name}") for name, kind in kinds.items()])
    both = own.join(carried, [key, "_group"])
    out = both.withColumns({name: _joined(kind, F.col(f"_c_{name}"), F.col(f"_i_{name}")) for name, kind in kinds.items()})
    return out.drop("_group", *[f"{p}_{name}" for p in ("_i", "_c") for name in totals])


def carry_in(df: DataFrame, layout: Layout, totals: Mapping[str, tuple[str, Column]], rows: DataFrame | None = None) -> DataFrame:
    """Add to every row, per name, what the runs before its own amount to (kinds as in ``earlier_totals``).

    One row per run is aggregated, and those are totalled by two levels. ``rows`` are the numbered rows that ``df`` was cut from, if
    they have all that the totals read: they are added up where they lie, without the copies, shuffle and sort of the runs.
    """
    key = layout.key
    if rows is None:
        source, own = df, {name: F.when(F.col("home"), x) for name, (_, x) in totals.items()}
    else:
        source, own = rows.withColumn("chunk", F.expr(f"gi div {layout.chunk_rows}")), {name: x for name, (_, x) in totals.items()}
    aggs = [_total(kind, own[name], F.col("gi")).alias(f"_t_{name}") for name, (kind, _) in totals.items()]
    runs = source.groupBy(key, "chunk").agg(*aggs)
    carried = earlier_totals(runs, key, "chunk", {name: (kind, F.col(f"_t_{name}")) for name, (kind, _) in totals.items()}, layout.group_rows)
    return join_runs(df, layout, carried.select(key, "chunk", *totals))


def join_runs(df: DataFrame, layout: Layout, per_run: DataFrame) -> DataFrame:
    """Bring one row per run to the run's rows.

    The rows are already partitioned by (symbol, chunk) and keep their order through a hash join, so
    neither a shuffle nor a sort of them is added; the hashed side has one row per run.
    """
    return df.join(per_run.hint("shuffle_hash"), [layout.key, "chunk"], "left")


def per_series(stats: DataFrame, name: str) -> DataFrame:
    """One row per series, written once to the shared folder.

    Spark then knows its size before planning the join with the data: below the broadcast threshold
    the data is not shuffled at all, above it the join is by shuffle with skewed keys split.
    """
    return stage(stats, name)


def running_sum(layout: Layout, expr: Column, carry: str) -> Column:
    """The series-wide running sum, given the carry column for the same expression."""
    return F.col(carry) + F.sum(F.when(F.col("home"), expr).otherwise(F.lit(0.0))).over(layout.upto())


def running_product(layout: Layout, expr: Column, carry: str) -> Column:
    return F.col(carry) * F.product(F.when(F.col("home"), expr).otherwise(F.lit(1.0))).over(layout.upto())


def filled(layout: Layout, expr: Column, carry: str) -> Column:
    """The value, or the newest earlier one that is not NULL."""
    return F.coalesce(F.last(expr, ignorenulls=True).over(layout.upto()), F.col(carry))


def tail_rows(df: DataFrame, layout: Layout, n: int) -> DataFrame:
    """The newest ``n`` rows of every series.

    Counting per time cell (of the key and the time alone) finds the oldest cell that can matter, so the ranking
    window sees ``n`` rows and one cell per symbol, not ``n`` rows from every input task, and the scan of all
    columns begins at the oldest such cell of any symbol: a literal, which prunes files and row groups.
    """
    key = layout.key
    celled = df.withColumn("_cell", _cell(layout))
    counts = celled.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.partitionBy(key).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    oldest = (
        counts.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
        .where(F.col("_newer") < n)
        .groupBy(key)
        .agg(F.min("_cell").alias("_oldest"))
    )
    oldest = per_series(oldest, "oldest")
    # One number for all series: nothing older than this is read again.
    start = oldest.agg(F.min("_oldest")).first()[0]
    if start is None:
        return df.limit(0)
    time = layout.order[0]
    since = F.timestamp_seconds(F.lit(start * layout.cell_seconds)).cast(df.schema[time].dataType)
    newest_first = Window.partitionBy(key).orderBy(*[F.desc(c) for c in layout.order])
    return (
        df.where(F.col(time) >= since)
        .withColumn("_cell", _cell(layout))
        .join(oldest, key)
        .where(F.col("_cell") >= F.col("_oldest"))
        .withColumn("_rn", F.row_number().over(newest_first))
        .where(F.col("_rn") <= n)
        .drop("_cell", "_oldest", "_rn")
    )
