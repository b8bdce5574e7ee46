"""Declared schemas of the stored tables. Times are UTC."""

from __future__ import annotations

from pyspark.sql import types as T

MEMBERS = ("sgd", "ridge", "pa")


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_D, _S, _TS = T.DoubleType(), T.StringType(), T.TimestampType()

TICKS = _table(
    ("symbol", _S), ("ts", _TS), ("price", _D), ("open", _D), ("volume", _D), ("return_pct", _D)
)
_FORECAST = (
    ("target", _TS),
    ("symbol", _S),
    ("y_hat", _D),
    ("y_hat_ret", _D),
    ("baseline", _D),
    ("horizon_min", T.IntegerType()),
    ("created_at", _TS),
    ("model_version", _S),
)
_PARTS = tuple((f"y_hat_{m}", _D) for m in MEMBERS) + tuple((f"w_{m}", _D) for m in MEMBERS)
# The 1-minute table began without member columns; ``tables.conform`` adds them to old data.
PREDICTIONS_V1 = _table(*_FORECAST, ("mae", _D), ("r2", _D))
PREDICTIONS = _table(*_FORECAST, ("mae", _D), ("r2", _D), *_PARTS)
PREDICTIONS_H30 = _table(*_FORECAST, *_PARTS)
META = _table(("key", _S), ("value", _S), ("updated_at", _TS))
DAILY = _table(
    ("symbol", _S),
    ("d", T.DateType()),
    ("open", _D),
    ("high", _D),
    ("low", _D),
    ("close", _D),
    ("adj_close", _D),
    ("volume", _D),
)
CALENDAR = _table(("ativo", _S), ("data", T.DateType()), ("evento", _S))
POSTS = _table(("ativo", _S), ("data", T.DateType()), ("texto_original", _S), ("sentimento", _D))
SENTIMENT = _table(("ativo", _S), ("data", T.DateType()), ("media_sentimento", _D))

# Contents of the two JSON values kept in META.
HYPERPARAMETERS = (
    "struct<sgd:struct<epsilon:double,alpha:double>,ridge:struct<alpha:double>,pa:struct<C:double>>"
)
STATE_JSON = f"struct<hps:{HYPERPARAMETERS},tuned_at:string,mae:double>"
ERRORS_JSON = "struct<sgd:double,ridge:double,pa:double>"
# The metadata keys of settings and error averages, by minutes of the horizon; a symbol and ":" stand before them.
STATE_KEYS = {1: "v4_state", 30: "v4_h30_state"}
ERROR_KEYS = {1: "v4_ewm_mae", 30: "v4_h30_ewm_mae"}
