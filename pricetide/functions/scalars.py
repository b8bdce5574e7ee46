"""Scalar rules shared by every job: clipping, changes, NULL and infinity handling, formats.

Missing values are NULL everywhere; NaN is turned into NULL once, when data is read.
Spark runs in ANSI mode, so divisions and casts that may fail use the ``try_`` forms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POS_INF = float("inf")
NEG_INF = float("-inf")
MINUTES_PER_DAY = 1440


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_nan(x: Column | str) -> Column:
    x = _col(x)
    return F.when(~F.isnan(x), x)


def to_number(x: Column | str) -> Column:
    """Text or number to double; what cannot be read becomes NULL."""
    return null_if_nan(_col(x).try_cast("double"))


def to_time(x: Column | str) -> Column:
    """Text to timestamp; what cannot be read becomes NULL."""
    return _col(x).try_cast("timestamp")


def clip(x: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Limit ``x`` to ``[lo, hi]``; NULL stays NULL (bare greatest/least would skip it)."""
    x = _col(x)
    bounded = x
    if hi is not None:
        bounded = F.least(bounded, F.lit(float(hi)))
    if lo is not None:
        bounded = F.greatest(bounded, F.lit(float(lo)))
    return F.when(x.isNotNull(), bounded)


def change(cur: Column | str, prev: Column | str) -> Column:
    """``cur/prev - 1``; over a zero base it is +-infinity, and NULL for 0/0."""
    cur, prev = _col(cur), _col(prev)
    over_zero = F.when(cur > 0, F.lit(POS_INF)).when(cur < 0, F.lit(NEG_INF))
    return F.when(prev == 0, over_zero).otherwise(F.try_divide(cur, prev) - 1.0)


def finite_or(x: Column | str, value: float) -> Column:
    """Replace NULL, NaN and both infinities (NaN sorts above infinity in Spark)."""
    x = _col(x)
    return F.coalesce(F.when(F.abs(x) < F.lit(POS_INF), x), F.lit(float(value)))


def change_or_zero(cur: Column | str, prev: Column | str) -> Column:
    """Relative change, 0 where it is undefined or infinite."""
    return F.coalesce(F.try_divide(_col(cur), _col(prev)) - 1.0, F.lit(0.0))


def bounded_change(cur: Column | str, prev: Column | str, limit: float) -> Column:
    """Relative change clipped to +-limit: over a zero base it is +-limit, and NULL for 0/0."""
    cur, prev = _col(cur), _col(prev)
    ratio = F.coalesce(F.try_divide(cur, prev) - 1.0, F.signum(cur) * F.lit(POS_INF))
    defined = cur.isNotNull() & prev.isNotNull() & ((cur != 0) | (prev != 0))
    return F.when(defined, F.greatest(F.lit(-limit), F.least(F.lit(limit), ratio)))


def log1p_or_zero(x: Column | str) -> Column:
    """log(1+x): 0 at x = -1, NULL below it."""
    x = _col(x)
    return F.when(x == -1.0, F.lit(0.0)).otherwise(F.log1p(x))


def log_ratio(cur: Column | str, prev: Column | str) -> Column:
    return F.ln(F.try_divide(_col(cur), _col(prev)))


def day_angle(ts: Column | str) -> Column:
    """Minute of the day as an angle."""
    ts = _col(ts)
    return (F.hour(ts) * 60 + F.minute(ts)) * F.lit(2.0 * math.pi / MINUTES_PER_DAY)


def tick_return_pct(price: Column | str, open_: Column | str) -> Column:
    """Percent move since the open, 0 where the open is 0 or missing."""
    price, open_ = _col(price), _col(open_)
    return F.coalesce(F.try_divide(price - open_, open_) * 100.0, F.lit(0.0))


def same_direction(forecast: Column, actual: Column, anchor: Column) -> Column:
    """1.0 when forecast and actual lie on the same side of the anchor, NULL if any is missing."""
    return (F.signum(forecast - anchor) == F.signum(actual - anchor)).cast("double")


def money(x: Column | str) -> Column:
    """Two decimals with thousands separators; an em dash for a missing value."""
    return F.coalesce(F.format_number(_col(x), 2), F.lit("—"))


def asset_of(symbol: Column | str) -> Column:
    """'ABC/USD' -> 'abc'."""
    return F.lower(F.split(_col(symbol), "/")[0])


def minute_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:00")


def local_time(ts: Column | str, offset: str = "-03:00") -> Column:
    """A UTC time shown at a fixed offset."""
    return F.from_utc_timestamp(_col(ts), offset)


def strip(x: Column | str) -> Column:
    """Trim blanks, tabs and line breaks at both ends."""
    return F.btrim(_col(x), F.lit(" \t\n\r\f\v"))
