"""DuckDB SQL for the registered queries, over the same given tables."""

from __future__ import annotations

LAGS = (1, 2, 3, 4, 5, 10, 15, 30, 60)
SPANS = (5, 10, 20, 30)
MEMBERS = ("sgd", "ridge", "pa")

ORACLES: dict[str, str] = {}


def r(expr: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def rr(names, digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def clip(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"


def change(cur: str, prev: str, limit: float) -> str:
    """Clipped relative change; +-limit over a zero base, NULL for 0/0."""
    return (
        f"CASE WHEN {cur} IS NULL OR {prev} IS NULL THEN NULL "
        f"WHEN {prev} = 0 THEN CASE WHEN {cur} > 0 THEN {limit} WHEN {cur} < 0 THEN -{limit} END "
        f"ELSE greatest(-{limit}, least({limit}, {cur} / {prev} - 1)) END"
    )


def change0(cur: str, prev: str) -> str:
    return f"coalesce(CASE WHEN {prev} <> 0 THEN {cur} / {prev} - 1 END, 0.0)"


BASE = """
base AS (
  SELECT event_type AS symbol, ts, event_id AS seq, 100.0::DOUBLE + value / 100.0::DOUBLE AS price,
         CAST(props->>'$.k' AS DOUBLE) AS volume
  FROM events)"""

TICKS = (
    BASE
    + """,
opens AS (
  SELECT symbol, CAST(ts AS DATE) AS day, arg_min(price, row(ts, seq)) AS open FROM base GROUP BY ALL),
ticks AS (
  SELECT b.*, o.open,
         coalesce(CASE WHEN o.open <> 0 THEN (b.price - o.open) / o.open * 100.0::DOUBLE END, 0.0) AS return_pct
  FROM base b JOIN opens o ON b.symbol = o.symbol AND CAST(b.ts AS DATE) = o.day)"""
)

RAW = (
    BASE
    + """,
twice AS (
  SELECT symbol, ts, seq, price, volume, FALSE AS later FROM base
  UNION ALL SELECT symbol, ts, seq + 1000000000, price + 0.01::DOUBLE, volume, TRUE FROM base),
raw AS (
  SELECT symbol, CASE WHEN volume = 0 THEN 'NaT' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts,
         seq,
         CASE WHEN volume = 1 AND NOT later THEN 'abc' WHEN volume = 2 AND later THEN 'abc'
              ELSE CAST(price AS VARCHAR) END AS price, volume
  FROM twice)"""
)

BARS = (
    BASE
    + """,
hour_bars AS (
  SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS minute, arg_max(price, row(ts, seq)) AS price,
         sum(volume) AS volume, count(*) AS n FROM base GROUP BY 1, 2)"""
)

PREDS = (
    BARS
    + """,
members AS (
  SELECT symbol, minute + INTERVAL 1 HOUR AS target, price AS baseline, price AS y_hat_sgd,
         avg(price) OVER (PARTITION BY symbol ORDER BY minute ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
           AS y_hat_ridge,
         2 * price - coalesce(lag(price) OVER (PARTITION BY symbol ORDER BY minute), price) AS y_hat_pa
  FROM hour_bars),
preds AS (
  SELECT *, y_hat / baseline - 1 AS y_hat_ret
  FROM (SELECT *, (y_hat_sgd + y_hat_ridge + y_hat_pa) / 3 AS y_hat FROM members)),
joined AS (
  SELECT p.*, b.price AS price_real
  FROM preds p LEFT JOIN hour_bars b ON p.symbol = b.symbol AND p.target = b.minute),
ev AS (
  SELECT *, y_hat - price_real AS erro, baseline - price_real AS erro_base,
         CAST(sign(y_hat - baseline) = sign(price_real - baseline) AS DOUBLE) AS acerto_dir,
         CAST(abs(y_hat - price_real) < abs(baseline - price_real) AS DOUBLE) AS melhor_que_base
  FROM joined)"""
)

DAILY = """
daily AS (
  SELECT 'goods' AS symbol, CAST(l_shipdate AS DATE) AS d,
         arg_min(l_extendedprice, row(l_orderkey, l_linenumber, l_extendedprice)) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         arg_max(l_extendedprice, row(l_orderkey, l_linenumber, l_extendedprice)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 2)"""

ASSETS = DAILY.replace("'goods' AS", "CASE l_returnflag WHEN 'A' THEN 'de' WHEN 'N' THEN 'en' ELSE 'fr' END AS").replace("GROUP BY 2", "GROUP BY 1, 2")

FLAGS = """
calendar AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'de' WHEN 'O' THEN 'en' ELSE 'fr' END AS ativo, CAST(o_orderdate AS DATE) AS data,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'halving' WHEN '2-HIGH' THEN 'fork' END AS evento
  FROM orders)"""

TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
BREAK = "'[\\t\\n\\f\\r ]+'"
POSTS = f"""
posts AS (
  SELECT lang AS ativo, DATE '2024-01-01' + CAST(doc_id % 31 AS INT) AS data,
         trim(text, {TRIM}) AS texto, source, doc_id AS seq
  FROM documents)"""
SCORED = (
    POSTS
    + f""",
lexicon AS (
  SELECT word, (length(word) % 5 - 2) / 2.0::DOUBLE AS score
  FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), {BREAK})) AS word FROM benchmark)
  WHERE word <> ''),
words AS (SELECT seq, unnest(string_split_regex(lower(texto), {BREAK})) AS word FROM posts),
hits AS (SELECT seq, avg(score) AS m FROM words JOIN lexicon USING (word) GROUP BY seq),
scored AS (
  SELECT seq, ativo, data, coalesce(m, 0.0) AS sentimento FROM posts LEFT JOIN hits USING (seq))"""
)

W = "(PARTITION BY symbol ORDER BY ts, seq)"


def rows(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


UPTO = "(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} = {n} THEN {agg}({x}) OVER {rows(n)} END"


# ---- cleaning, bars, ticks --------------------------------------------------------------------

ORACLES["q_clean_ticks"] = f"""WITH {RAW},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS rn
         FROM raw WHERE ts <> 'NaT') WHERE rn = 1)
SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, seq, CAST(price AS DOUBLE) AS price, volume
FROM last WHERE price <> 'abc'"""
ORACLES["q_dedup_last"] = f"""WITH {RAW}
SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, seq, price, volume
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS rn FROM raw WHERE ts <> 'NaT')
WHERE rn = 1"""
ORACLES["q_dedup_first"] = f"""WITH {RAW}
SELECT symbol, ts, seq, price, volume
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) AS rn FROM raw) WHERE rn = 1"""
ORACLES["q_purge_keys"] = f"WITH {RAW} SELECT symbol, count(*) AS n FROM raw WHERE ts <> 'NaT' GROUP BY symbol"
ORACLES["q_tick_return"] = f"""WITH {TICKS}
SELECT symbol, ts, seq, price, volume, open, {r('return_pct')} AS return_pct,
       ts - INTERVAL 3 HOUR AS local_ts FROM ticks"""
ORACLES["q_feed_projection"] = f"""WITH {TICKS}
SELECT symbol, date_trunc('millisecond', ts)::TIMESTAMP AS ts, price, open, volume,
       {r('return_pct')} AS return_pct FROM ticks"""
ORACLES["q_minute_keys"] = f"""WITH {BASE}
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:00') AS minute_key, count(*) AS n FROM base GROUP BY 1, 2"""
ORACLES["q_minute_bars"] = f"""WITH {BASE}
SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS minute, arg_max(price, row(ts, seq)) AS price,
       sum(volume) AS volume, count(*) AS n FROM base GROUP BY 1, 2"""
ORACLES["q_hour_bars"] = f"WITH {BARS} SELECT * FROM hour_bars"
ORACLES["q_normalized_columns"] = f"""WITH {BASE}
SELECT symbol, 'price' AS numeric, count(price) AS n, max(ts) AS last_ts FROM base GROUP BY symbol"""
ORACLES["q_history_gate"] = f"""WITH {BARS}
SELECT symbol, count(*) AS n FROM hour_bars GROUP BY symbol HAVING count(*) >= 500"""

# ---- indicators -------------------------------------------------------------------------------

RET = f"coalesce({change('price', f'lag(price) OVER {W}', 0.05)}, 0.0)"
ORACLES["q_returns_lags"] = f"""WITH {BASE},
s AS (SELECT symbol, ts, seq, {RET} AS ret FROM base)
SELECT symbol, seq, {r('ret')} AS ret,
       {', '.join(f"{r(f'lag(ret, {n}) OVER {W}')} AS ret_lag_{n}" for n in LAGS)} FROM s"""
ORACLES["q_vol_change"] = f"""WITH {BASE},
s AS (SELECT symbol, ts, seq, CASE WHEN volume > 0 THEN volume END AS volume FROM base),
f AS (SELECT *, last_value(volume IGNORE NULLS) OVER {UPTO} AS filled FROM s)
SELECT symbol, seq, filled, {r(change0('filled', f'lag(filled) OVER {W}'))} AS vol_chg,
       {r('ln(1 + volume)')} AS log_vol FROM f"""
ORACLES["q_targets"] = f"""WITH {BASE}
SELECT symbol, seq, {r(change(f'lead(price) OVER {W}', 'price', 0.05))} AS y_ret,
       {r(change(f'lead(price, 30) OVER {W}', 'price', 0.15))} AS y_ret_h,
       {r(f'(price / lag(price) OVER {W} - 1) * 100')} AS return_pct,
       {r(f'ln(price / lag(price) OVER {W})')} AS return_log FROM base"""


def scans(source: str, extra: str = "", price: str = "price") -> str:
    """Exponential averages of the price, of gains and losses, and of the MACD line, by recursion.

    The result has one row per series row ``rn`` with e5..e30, fast, slow, up, down, sig.
    """
    spans = {f"e{n}": n for n in SPANS} | {"e7": 7, "fast": 12, "slow": 26}
    start = ", ".join(f"{price} AS {k}" for k in spans)
    step = ", ".join(f"n.{price} * (2e0 / {s + 1}) + p.{k} * (1e0 - 2e0 / {s + 1}) AS {k}" for k, s in spans.items())
    fast = f"(n.{price} * (2e0 / 13) + p.fast * (1e0 - 2e0 / 13))"
    slow = f"(n.{price} * (2e0 / 27) + p.slow * (1e0 - 2e0 / 27))"
    gain, loss = "greatest(n.delta, 0e0)", "greatest(-n.delta, 0e0)"
    a = "(1e0 / 14)"
    return f"""
s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {extra or 'ts, seq'}) AS rn,
             {price} - lag({price}) OVER (PARTITION BY symbol ORDER BY {extra or 'ts, seq'}) AS delta
      FROM {source}),
scan AS (
  SELECT symbol, rn, {start}, NULL::DOUBLE AS up, NULL::DOUBLE AS down, 0e0 AS sig FROM s WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.rn, {step},
         CASE WHEN n.rn = 2 THEN {gain} ELSE {gain} * {a} + p.up * (1e0 - {a}) END,
         CASE WHEN n.rn = 2 THEN {loss} ELSE {loss} * {a} + p.down * (1e0 - {a}) END,
         ({fast} - {slow}) * (2e0 / 10) + p.sig * (1e0 - 2e0 / 10)
  FROM scan p JOIN s n ON n.symbol = p.symbol AND n.rn = p.rn + 1)"""


SCAN = f"WITH RECURSIVE {BASE}, {scans('base')}"
ORACLES["q_ema"] = f"""{SCAN}
SELECT symbol, seq, {', '.join(f"{r(f'e{n}')} AS ema_{n}" for n in SPANS)} FROM s JOIN scan USING (symbol, rn)"""
GAPS = ", ".join(
    f"{r(change('price', f'e{n}', 0.2))} AS ema_gap_{n}, "
    f"{r(change(f'e{n}', f'lag(e{n}) OVER {W}', 0.1))} AS ema_slope_{n}"
    for n in SPANS
)
ORACLES["q_ema_gap_slope"] = f"{SCAN} SELECT symbol, seq, {GAPS} FROM s JOIN scan USING (symbol, rn)"
ORACLES["q_rsi"] = f"""{SCAN}
SELECT symbol, seq, {r('coalesce(100 - 100 / (1 + up / (down + 1e-6)), 50.0)')} AS rsi_14
FROM s JOIN scan USING (symbol, rn)"""
ORACLES["q_macd"] = f"""{SCAN}
SELECT symbol, seq, {r('fast - slow')} AS macd, {r('sig')} AS macd_signal, {r('fast - slow - sig')} AS macd_hist
FROM s JOIN scan USING (symbol, rn)"""
ORACLES["q_rolling_std"] = f"""WITH {BASE},
s AS (SELECT symbol, ts, seq, {RET} AS ret FROM base),
t AS (SELECT symbol, seq, {', '.join(f"{full('stddev_samp', 'ret', n)} AS v{n}" for n in SPANS)} FROM s)
SELECT symbol, seq, {', '.join(f"{r(clip(f'v{n}', 0.0, 0.05))} AS rstd_{n}" for n in SPANS)} FROM t"""
ORACLES["q_bollinger"] = f"""WITH {BASE},
s AS (SELECT symbol, seq, {full('avg', 'price', 20)} AS mid, {full('stddev_samp', 'price', 20)} AS sd FROM base)
SELECT symbol, seq, {r('mid + 2 * sd')} AS upper, {r('mid - 2 * sd')} AS lower,
       {r('coalesce(4 * sd / (mid + 1e-6), 0.0)')} AS bb_width FROM s"""
ORACLES["q_sma"] = f"""WITH {BASE}
SELECT symbol, seq, {r(full('avg', 'price', 7))} AS sma_7, {r(full('avg', 'price', 30))} AS sma_30,
       {r(full('stddev_samp', 'price', 7))} AS vol_7 FROM base"""
SIGNED = f"coalesce(sign(price - lag(price) OVER {W}) * volume, 0.0)"
ORACLES["q_obv"] = f"""WITH {BASE},
s AS (SELECT *, {SIGNED} AS signed FROM base),
o AS (SELECT *, sum(signed) OVER {UPTO} AS obv FROM s)
SELECT symbol, seq, obv + 0.0 AS obv,
       {r(clip(change0('obv', f'lag(obv) OVER {W}'), -0.5, 0.5))} AS obv_chg FROM o"""
ANGLE = "(extract(hour FROM ts) * 60 + extract(minute FROM ts)) * (2 * pi() / 1440)"
ORACLES["q_seasonality"] = f"""WITH {BASE}
SELECT symbol, seq, {r(f'sin({ANGLE})')} AS sin_m, {r(f'cos({ANGLE})')} AS cos_m FROM base"""


def features(ret_clip: float, std_clip: float, eps: str, horizon: int, limit: float, target: str, drop: bool) -> str:
    names = ["price", "open", "volume", "return_pct", "ret", "vol_chg", "log_vol"]
    names += [f"ret_lag_{n}" for n in LAGS] + [f"ema_gap_{n}" for n in SPANS]
    names += [f"ema_slope_{n}" for n in SPANS] + [f"rstd_{n}" for n in SPANS]
    names += ["rsi_14", "macd", "macd_signal", "macd_hist", "bb_width", "obv", "obv_chg", "sin_m", "cos_m", target]
    ret = f"coalesce({change('price', f'lag(price) OVER {W}', ret_clip)}, 0.0)"
    where = " WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names) if drop else ""
    return f"""WITH RECURSIVE {TICKS}, {scans('ticks')},
a AS (SELECT *, {ret} AS ret, last_value(volume IGNORE NULLS) OVER {UPTO} AS filled, {SIGNED} AS signed,
             {full('avg', 'price', 20)} AS mid, {full('stddev_samp', 'price', 20)} AS sd
      FROM s JOIN scan USING (symbol, rn)),
b AS (SELECT *, sum(signed) OVER {UPTO} AS obv,
             {', '.join(f"{full('stddev_samp', 'ret', n)} AS v{n}" for n in SPANS)} FROM a),
c AS (SELECT *, {change0('filled', f'lag(filled) OVER {W}')} AS vol_chg, ln(1 + volume) AS log_vol,
             {', '.join(f"lag(ret, {n}) OVER {W} AS ret_lag_{n}" for n in LAGS)},
             {', '.join(f"{change('price', f'e{n}', 0.2)} AS ema_gap_{n}" for n in SPANS)},
             {', '.join(f"{change(f'e{n}', f'lag(e{n}) OVER {W}', 0.1)} AS ema_slope_{n}" for n in SPANS)},
             {', '.join(f"{clip(f'v{n}', 0.0, std_clip)} AS rstd_{n}" for n in SPANS)},
             coalesce(100 - 100 / (1 + up / (down + {eps})), 50.0) AS rsi_14,
             fast - slow AS macd, sig AS macd_signal, fast - slow - sig AS macd_hist,
             coalesce(4 * sd / (mid + {eps}), 0.0) AS bb_width,
             {clip(change0('obv', f'lag(obv) OVER {W}'), -0.5, 0.5)} AS obv_chg,
             sin({ANGLE}) AS sin_m, cos({ANGLE}) AS cos_m,
             {change(f'lead(price, {horizon}) OVER {W}', 'price', limit)} AS {target} FROM b)
SELECT symbol, seq, {rr(names)} FROM c{where}"""


ORACLES["q_features_1m"] = features(0.05, 0.05, "1e-6", 1, 0.05, "y_ret", True)
ORACLES["q_features_h30"] = features(0.1, 0.1, "1e-8", 30, 0.15, "y_ret_h", False)

_LOGS = ("log_price", "log_vol")
_EXP = ", ".join(
    f"avg({c}) OVER {UPTO} AS {c}_mean, stddev_pop({c}) OVER {UPTO} AS {c}_std" for c in _LOGS
)
_SCALED = ", ".join(
    f"({c} - {c}_mean) / CASE WHEN {c}_std > 0 THEN {c}_std ELSE 1.0 END AS {c}_scaled" for c in _LOGS
)
ORACLES["q_expanding_scaler"] = f"""WITH {BASE},
l AS (SELECT *, ln(price) AS log_price, ln(1 + volume) AS log_vol FROM base),
e AS (SELECT *, {_EXP} FROM l), z AS (SELECT *, {_SCALED} FROM e)
SELECT symbol, seq, {rr([f'{c}_{k}' for c in _LOGS for k in ('mean', 'std', 'scaled')])} FROM z"""

# ---- evaluation -------------------------------------------------------------------------------

ORACLES["q_eval_join"] = f"""WITH {PREDS}
SELECT symbol, target, {rr(['price_real', 'y_hat', 'y_hat_ret', 'erro', 'erro_base'])}, acerto_dir, melhor_que_base
FROM ev"""
KPIS = f"""SELECT symbol, count(*) AS n, {r('avg(abs(erro))')} AS mae,
       {r('avg(CASE WHEN price_real <> 0 THEN abs((price_real - y_hat) / price_real) END) * 100')} AS mape,
       {r('sqrt(avg((price_real - y_hat) * (price_real - y_hat)))')} AS rmse,
       {r('100 * avg(acerto_dir)')} AS acc_dir, {r('100 * avg(melhor_que_base)')} AS beat_base,
       count(*) FILTER (price_real IS NULL) AS pending"""
TAIL = "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY target DESC) AS rn FROM ev)"
ORACLES["q_kpis"] = f"WITH {PREDS} {KPIS} FROM ev GROUP BY symbol"
ORACLES["q_kpis_tail"] = f"WITH {PREDS} {KPIS} FROM {TAIL} WHERE rn <= 360 GROUP BY symbol"
ORACLES["q_pending"] = f"""WITH {PREDS}
SELECT symbol, count(*) FILTER (price_real IS NULL) AS pending FROM ev GROUP BY symbol"""
ORACLES["q_alert"] = f"""WITH {PREDS},
lim AS (SELECT symbol, stddev_pop(price) * 0.5 AS err_limit
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn FROM base)
        WHERE rn <= 300 GROUP BY symbol),
scoped AS (
  SELECT 'all' AS scope, symbol, erro, acerto_dir FROM ev
  UNION ALL
  SELECT 'day', symbol, erro, acerto_dir FROM (SELECT *, max(target) OVER (PARTITION BY symbol) AS m FROM ev)
  WHERE target > m - INTERVAL 1440 MINUTE),
fig AS (SELECT scope, symbol, avg(abs(erro)) AS mae, 100 * avg(acerto_dir) AS acc_dir FROM scoped GROUP BY ALL)
SELECT symbol, {rr(['mae', 'acc_dir', 'err_limit'])},
       CASE WHEN mae > err_limit THEN 'error' WHEN acc_dir < 50 THEN 'warn' ELSE 'ok' END AS state, scope
FROM fig LEFT JOIN lim USING (symbol)"""
ORACLES["q_mu_sigma"] = f"""WITH {BASE},
s AS (SELECT symbol, avg(price) AS mu, stddev_pop(price) AS sigma FROM base GROUP BY symbol)
SELECT symbol, {r('mu')} AS mu, {r('sigma')} AS sigma, {r('mu + sigma')} AS upper, {r('mu - sigma')} AS lower FROM s"""
ORACLES["q_latest"] = f"""WITH {PREDS},
p AS (SELECT symbol, arg_max(price, minute) AS last_price FROM hour_bars GROUP BY symbol),
q AS (SELECT symbol, arg_max(y_hat, target) AS last_pred FROM ev WHERE y_hat IS NOT NULL GROUP BY symbol)
SELECT symbol, {rr(['last_price', 'last_pred'])}, format('{{:,.2f}}', last_price) AS last_price_text,
       format('{{:,.2f}}', last_pred) AS last_pred_text FROM p JOIN q USING (symbol)"""
_HOURS = ", ".join(
    f"round_even(avg(acerto_dir) FILTER (extract(hour FROM target) = {h}) * 100, 1) + 0.0 AS h{h}" for h in range(24)
)
ORACLES["q_heatmap"] = f"""WITH {PREDS}
SELECT symbol, dayname(target) AS dia, {_HOURS} FROM ev WHERE acerto_dir IS NOT NULL GROUP BY 1, 2"""
ORACLES["q_anchor_price"] = f"""WITH {BARS}
SELECT symbol, minute, price AS close, {r('lag(price, 10) OVER (PARTITION BY symbol ORDER BY minute)')} AS price_t
FROM hour_bars"""


def weights(seed: float, eps: str, after: bool) -> str:
    err = ", ".join(f"abs(price_real - y_hat_{m}) AS err_{m}" for m in MEMBERS)
    first = ", ".join(f"coalesce(0.2 * err_{m} + 0.8 * {seed}, {seed}) AS mae_{m}, {seed}::DOUBLE AS was_{m}" for m in MEMBERS)
    step = ", ".join(f"coalesce(0.2 * n.err_{m} + 0.8 * p.mae_{m}, p.mae_{m}), p.mae_{m}" for m in MEMBERS)
    used = "mae" if after else "was"
    total = "(" + " + ".join(f"1 / ({used}_{m} + {eps})" for m in MEMBERS) + ")"
    out = [f"{r(f'err_{m}')} AS err_{m}" for m in MEMBERS] if after else []
    out += [f"{r(f'{used}_{m}')} AS mae_{m}" for m in MEMBERS]
    out += [f"{r(f'1 / ({used}_{m} + {eps}) / {total}')} AS w_{m}" for m in MEMBERS]
    return f"""WITH RECURSIVE {PREDS},
gaps AS (SELECT * REPLACE (CASE WHEN extract(hour FROM target) % 5 <> 0 THEN y_hat_ridge END AS y_hat_ridge) FROM ev),
e AS (SELECT symbol, target, {err}, row_number() OVER (PARTITION BY symbol ORDER BY target) AS rn
      FROM gaps WHERE price_real IS NOT NULL),
m AS (SELECT symbol, rn, {first} FROM e WHERE rn = 1
      UNION ALL SELECT n.symbol, n.rn, {step} FROM m p JOIN e n ON n.symbol = p.symbol AND n.rn = p.rn + 1)
SELECT symbol, target, {', '.join(out)} FROM e JOIN m USING (symbol, rn)"""


ORACLES["q_ewm_weights"] = weights(0.01, "1e-6", True)
ORACLES["q_ewm_weights_before"] = weights(0.02, "1e-8", False)
ORACLES["q_delayed_label"] = f"""WITH {BASE},
b AS (SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS minute, arg_max(price, row(ts, seq)) AS price
      FROM base GROUP BY 1, 2)
SELECT f.symbol, f.minute, f.price AS price_then, p.minute AS label_at, p.price AS price_now,
       {r(change('p.price', 'f.price', 0.15))} AS y_label
FROM b f JOIN b p ON f.symbol = p.symbol AND p.minute = f.minute + INTERVAL 30 MINUTE"""
_THIRD = r("1e0 / 3e0")
ORACLES["q_recent_components"] = f"""WITH {PREDS}
SELECT symbol, target, price_real, {r('y_hat')} AS y_hat, y_hat_sgd, {rr(['y_hat_ridge', 'y_hat_pa'])},
       {', '.join(f'{_THIRD} AS w_{m}' for m in MEMBERS)}, {r('erro')} AS erro, acerto_dir
FROM ev QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY target DESC) <= 200"""
ORACLES["q_export"] = f"""WITH {PREDS}
SELECT target AS "Datetime", price_real AS "Price_real", {rr(['y_hat', 'erro', 'erro_base'])}, acerto_dir,
       {r('y_hat_ret')} AS y_hat_ret, baseline FROM ev"""
ORACLES["q_tail_window"] = f"""WITH {BASE}
SELECT symbol, ts, seq, price, volume
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn FROM base) WHERE rn <= 1200"""
ORACLES["q_tail_preview"] = f"WITH {DAILY} SELECT * FROM daily ORDER BY d DESC LIMIT 10"

# ---- backtest ---------------------------------------------------------------------------------


def curve(threshold_bps: float, fee_bps: float, source: str) -> str:
    w = "(PARTITION BY symbol ORDER BY target)"
    upto = "(PARTITION BY symbol ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""WITH {PREDS},
g AS (SELECT symbol, target, coalesce(CAST(y_hat_ret > {threshold_bps} / 10000 AS INT), 0) AS signal,
             coalesce(price_real / lag(price_real) OVER {w} - 1, 0.0) AS ret_real FROM {source}),
t AS (SELECT *, coalesce(lag(signal) OVER {w}, 0) * ret_real
             - coalesce(abs(signal - lag(signal) OVER {w}), 0) * ({fee_bps}e0 / 10000) AS ret_model FROM g),
q AS (SELECT *, product(1 + ret_model) OVER {upto} AS eq_model, product(1 + ret_real) OVER {upto} AS eq_hold FROM t),
k AS (SELECT *, max(eq_model) OVER {upto} AS peak FROM q),
c AS (SELECT *, (eq_model - peak) / peak AS drawdown FROM k)"""


_SUMMARY = f"""SELECT symbol, {r('arg_max(eq_model, target) - 1')} AS total_model,
       {r('arg_max(eq_hold, target) - 1')} AS total_hold, {r('min(drawdown)')} AS max_drawdown FROM c GROUP BY symbol"""
_CURVE = curve(5, 4, "ev")
ORACLES["q_backtest_curve"] = f"""{_CURVE}
SELECT symbol, target, signal, {rr(['ret_real', 'ret_model', 'eq_model', 'eq_hold', 'peak', 'drawdown'])} FROM c"""
ORACLES["q_backtest_summary"] = f"{_CURVE} {_SUMMARY}"
ORACLES["q_backtest_recent"] = f"{curve(2, 1, f'{TAIL} WHERE rn <= 360')} {_SUMMARY}"

# ---- daily features and statistics ------------------------------------------------------------


def drows(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def dfull(agg: str, n: int) -> str:
    return f"CASE WHEN rn >= {n} THEN {agg}(close) OVER {drows(n)} END"


DW = "(PARTITION BY symbol ORDER BY d)"
INDICATORS = f"""{scans('daily', 'd', 'close')},
ind AS (
  SELECT symbol, d, open, high, low, close, volume, rn - 1 AS gi,
         (close / lag(close) OVER {DW} - 1) * 100 AS return_pct, ln(close / lag(close) OVER {DW}) AS return_log,
         {dfull('avg', 7)} AS sma_7, {dfull('avg', 30)} AS sma_30,
         CASE WHEN rn >= 7 THEN e7 END AS ema_7, CASE WHEN rn >= 30 THEN e30 END AS ema_30,
         CASE WHEN rn >= 14 THEN CASE WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END END AS rsi_14,
         CASE WHEN rn >= 26 THEN fast - slow END AS macd, CASE WHEN rn >= 34 THEN sig END AS macd_s,
         CASE WHEN rn >= 34 THEN fast - slow - sig END AS macd_h,
         {dfull('avg', 20)} - 2 * {dfull('stddev_pop', 20)} AS bbl, {dfull('avg', 20)} AS bbm,
         {dfull('avg', 20)} + 2 * {dfull('stddev_pop', 20)} AS bbu, {dfull('stddev_samp', 7)} AS volatilidade_7d
  FROM s JOIN scan USING (symbol, rn))"""
IND = [
    "return_pct", "return_log", "sma_7", "sma_30", "ema_7", "ema_30", "rsi_14", "macd", "macd_s", "macd_h",
    "bbl", "bbm", "bbu", "volatilidade_7d",
]
ORACLES["q_daily_indicators"] = f"""WITH RECURSIVE {DAILY}, {INDICATORS}
SELECT symbol, d, gi, {rr(IND, 4)} FROM ind"""
_FLAG = "CAST(EXISTS (SELECT 1 FROM calendar c WHERE c.ativo = {s} AND c.data = {d} AND c.evento = '{k}') AS INT) AS evento_{k}"
ORACLES["q_event_flags"] = f"""WITH {ASSETS}, {FLAGS}
SELECT symbol, d, {_FLAG.format(s='symbol', d='daily.d', k='halving')}, {_FLAG.format(s='symbol', d='daily.d', k='fork')} FROM daily"""
ORACLES["q_daily_features"] = f"""WITH RECURSIVE {ASSETS}, {FLAGS}, {SCORED}, {INDICATORS},
sent AS (SELECT ativo, data - 10227 AS d, avg(sentimento) AS m FROM scored GROUP BY 1, 2),
st AS (SELECT symbol, avg(volume) AS mu, stddev_samp(volume) AS sd FROM daily GROUP BY 1)
SELECT i.d, symbol, open, high, low, close, volume, {rr(IND, 4)},
       {r('CASE WHEN sd > 0 THEN (volume - mu) / sd ELSE 0.0 END', 4)} AS volume_norm,
       {_FLAG.format(s='i.symbol', d='i.d', k='halving')}, {_FLAG.format(s='i.symbol', d='i.d', k='fork')},
       {r('coalesce(m, 0.0)', 4)} AS media_sentimento
FROM ind i JOIN st USING (symbol) LEFT JOIN sent ON sent.ativo = i.symbol AND sent.d = i.d WHERE gi >= 33"""
ORACLES["q_asset_calendar"] = """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'halving' WHEN '2-HIGH' THEN 'fork'
       ELSE o_orderpriority END AS evento, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_date
FROM orders GROUP BY 1"""
ORACLES["q_volume_z"] = f"""WITH {BASE},
st AS (SELECT symbol, avg(volume) AS mu, stddev_samp(volume) AS sd FROM base GROUP BY symbol)
SELECT symbol, seq, volume, {r('CASE WHEN sd > 0 THEN (volume - mu) / sd ELSE 0.0 END')} AS volume_norm
FROM base JOIN st USING (symbol)"""
TARGETS = f"""WITH {BASE},
v AS (SELECT *, (price / lag(price) OVER {W} - 1) * 100 AS return_pct FROM base),
t AS (SELECT *, lead(return_pct) OVER {W} AS target_pct FROM v)"""
ORACLES["q_next_target"] = f"""WITH {BASE}, t AS (SELECT symbol, seq, lead(price - 101.0::DOUBLE) OVER {W} AS x FROM base)
SELECT symbol, seq, {r('x')} AS target_pct, CAST(x > 0 AS DOUBLE) AS target_bin FROM t"""
ORACLES["q_class_counts"] = f"""{TARGETS}
SELECT symbol, 0 AS classe, count(*) FILTER (target_pct <= 0) AS n FROM t GROUP BY symbol
UNION ALL SELECT symbol, 1, count(*) FILTER (target_pct > 0) FROM t GROUP BY symbol"""
_COLS = ("close", "high", "low", "open", "volume")
ORACLES["q_corr"] = f"WITH {DAILY} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round_even(corr({a}, {b}), 2) + 0.0 AS r FROM daily" for a in _COLS for b in _COLS
)
ORACLES["q_histogram"] = f"""WITH {BASE},
e AS (SELECT symbol, min(price) AS lo, max(price) AS hi, count(*) AS total FROM base GROUP BY symbol),
p AS (SELECT symbol, CAST(least(floor((price - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(*) AS n
      FROM base JOIN e USING (symbol) GROUP BY 1, 2),
g AS (SELECT e.*, CAST(unnest(range(50)) AS INT) AS bin FROM e)
SELECT symbol, bin, {r('lo + bin * ((hi - lo) / 50)')} AS left_edge, coalesce(n, 0) AS n,
       {r('coalesce(n, 0) / (total * ((hi - lo) / 50))')} AS density
FROM g LEFT JOIN p USING (symbol, bin)"""
ORACLES["q_normal_curve"] = f"""{TARGETS},
st AS (SELECT symbol, avg(target_pct) AS mu, stddev_pop(target_pct) AS sd, min(target_pct) AS lo, max(target_pct) AS hi
       FROM t GROUP BY symbol HAVING count(target_pct) > 5),
g AS (SELECT *, CAST(unnest(range(200)) AS INT) AS i FROM st), x AS (SELECT *, lo + (hi - lo) * i / 199 AS x FROM g)
SELECT symbol, i, {r('x')} AS x,
       {r('exp(-0.5 * ((x - mu) / sd) * ((x - mu) / sd)) / (sd * sqrt(2 * pi()))')} AS pdf FROM x"""
STATS = f"""WITH {BASE},
v AS (SELECT *, lead(price - 101.0::DOUBLE) OVER {W} AS target_pct FROM base),
t AS (SELECT * FROM v WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20')"""
ORACLES["q_stats_bands"] = f"""{STATS},
s AS (SELECT symbol, avg(price) AS mu, stddev_pop(price) AS sigma FROM t GROUP BY symbol)
SELECT symbol, {r('mu')} AS mu, {r('sigma')} AS sigma, {r('mu + sigma')} AS upper, {r('mu - sigma')} AS lower FROM s"""
ORACLES["q_stats_classes"] = f"""{STATS}
SELECT symbol, 0 AS classe, count(*) FILTER (target_pct <= 0) AS n FROM t GROUP BY symbol
UNION ALL SELECT symbol, 1, count(*) FILTER (target_pct > 0) FROM t GROUP BY symbol"""
ORACLES["q_stats_histogram"] = f"""{STATS},
e AS (SELECT symbol, min(target_pct) AS lo, max(target_pct) AS hi, count(target_pct) AS total FROM t GROUP BY symbol),
p AS (SELECT symbol, CAST(least(floor((target_pct - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(*) AS n
      FROM t JOIN e USING (symbol) GROUP BY 1, 2),
g AS (SELECT e.*, CAST(unnest(range(50)) AS INT) AS bin FROM e)
SELECT symbol, bin, {r('lo + bin * ((hi - lo) / 50)')} AS left_edge, coalesce(n, 0) AS n,
       {r('coalesce(n, 0) / (total * ((hi - lo) / 50))')} AS density
FROM g LEFT JOIN p USING (symbol, bin)"""
ORACLES["q_freshness"] = f"""WITH {BASE}, m AS (SELECT symbol, CAST(max(ts) AS DATE) AS last_date FROM base GROUP BY symbol)
SELECT symbol, last_date, last_date = DATE '2024-01-30' AS is_fresh,
       CAST(DATE '2024-01-31' - last_date AS INT) AS days_behind FROM m"""
ORACLES["q_date_bounds"] = f"""WITH {BASE}
SELECT symbol, CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date FROM base GROUP BY symbol"""
ORACLES["q_date_filter"] = """SELECT event_type, count(*) AS n FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY event_type"""

# ---- stored tables ----------------------------------------------------------------------------

KEYED = f"WITH {POSTS}, keyed AS (SELECT *, sha256(texto) AS text_key FROM posts)"
FIRST = "row_number() OVER (PARTITION BY ativo, data, text_key ORDER BY seq) AS rn"
ORACLES["q_insert_ignore"] = f"""{KEYED},
old AS (SELECT DISTINCT ativo, data, text_key FROM keyed WHERE source < 'src15')
SELECT seq, ativo, data, source, text_key FROM (SELECT *, {FIRST} FROM keyed) k
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM old o
  WHERE o.ativo = k.ativo AND o.data = k.data AND o.text_key = k.text_key)"""
ORACLES["q_post_duplicates"] = f"""{KEYED}
SELECT ativo, data, text_key, min(seq) AS first_row, count(*) - 1 AS surplus FROM keyed
GROUP BY ativo, data, text_key HAVING count(*) > 1"""
ORACLES["q_keep_first_posts"] = f"{KEYED} SELECT seq, ativo, data FROM (SELECT *, {FIRST} FROM keyed) WHERE rn = 1"
ORACLES["q_upsert_latest"] = f"""WITH {PREDS}
SELECT symbol, date_trunc('minute', target)::TIMESTAMP AS target, {r('y_hat + 1')} AS y_hat, 60 AS horizon_min,
       2 AS version FROM preds"""
ORACLES["q_compact_log"] = ORACLES["q_upsert_latest"]
ORACLES["q_meta_latest"] = """SELECT event_type || '_state' AS key, CAST(arg_max(props, ts)->>'$.k' AS BIGINT) AS k,
       arg_max(props, ts) AS text FROM events GROUP BY event_type"""
ORACLES["q_schema_evolve"] = f"""WITH {PREDS}
SELECT 'v4' AS model_version, count(*) AS n, count(y_hat) AS with_y_hat, count(y_hat_sgd) AS with_members FROM preds
UNION ALL SELECT 'v3', count(*), count(y_hat), 0 FROM preds"""

# ---- sentiment --------------------------------------------------------------------------------

ORACLES["q_sentiment_posts"] = f"WITH {SCORED} SELECT seq, ativo, data, {r('sentimento')} AS sentimento FROM scored"
ORACLES["q_sentiment_daily"] = f"""WITH {SCORED}
SELECT ativo, data, {r('avg(sentimento)')} AS media_sentimento FROM scored GROUP BY ativo, data"""
ORACLES["q_upsert_sentiment"] = f"""WITH {SCORED},
one AS (SELECT s.ativo, s.data, avg(sentimento) AS m FROM scored s JOIN posts p USING (seq)
        WHERE source < 'src15' GROUP BY s.ativo, s.data),
two AS (SELECT ativo, data, avg(sentimento) AS m FROM scored WHERE ativo <> 'en' GROUP BY ativo, data)
SELECT ativo, data, {r('coalesce(two.m, one.m)')} AS media_sentimento,
       CASE WHEN two.m IS NULL THEN 1 ELSE 2 END AS version
FROM one FULL JOIN two USING (ativo, data)"""
ORACLES["q_posts_range"] = f"""WITH feeds AS (
  SELECT 'documents' AS feed, lang AS ativo, '  ' || text || ' ' || chr(10) AS title,
         1704067200 + doc_id * 3600 AS t, doc_id AS seq FROM documents
  UNION ALL
  SELECT 'conversations', 'chat', text, 1704067200 + conv_id * 3600 + turn, conv_id * 1000 + turn FROM conversations),
p AS (SELECT feed, ativo, CAST(make_timestamp(t * 1000000) AS DATE) AS data, seq, trim(title, {TRIM}) AS texto FROM feeds)
SELECT feed, ativo, data, seq, length(texto) AS n_chars FROM p
WHERE texto <> '' AND data BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'"""

ORACLES["q_stream_bars"] = ORACLES["q_hour_bars"]
ORACLES["q_stream_targets"] = f"""WITH {BASE},
b AS (SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS minute, arg_max(price, row(ts, seq)) AS price
      FROM base GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY minute) AS rn, max(minute) OVER () AS newest FROM b)
SELECT symbol, minute + INTERVAL 1 MINUTE AS target, {r('price')} AS baseline FROM n WHERE rn >= 100 AND minute < newest"""

# ---- joins of streams, late rows --------------------------------------------------------------

ORACLES["q_stream_scores"] = ORACLES["q_eval_join"] + " WHERE price_real IS NOT NULL"
ORACLES["q_stream_settled"] = ORACLES["q_eval_join"]
ORACLES["q_stream_pending"] = ORACLES["q_pending"]
ORACLES["q_stream_labels"] = ORACLES["q_delayed_label"]
ORACLES["q_late_bars"] = ORACLES["q_hour_bars"]

# ---- tables replaced by version, tables in order, posts as a stream ---------------------------

ORACLES["q_table_versions"] = f"""WITH {BARS}
SELECT symbol, minute, {r('price')} AS price, volume, n, 1 AS table_version FROM hour_bars
UNION ALL SELECT symbol, minute, {r('price * 2')}, volume, n, 2 FROM hour_bars WHERE n > 1"""
ORACLES["q_history"] = f"""WITH {ASSETS}
SELECT *, CAST(year(d) AS INT) AS year FROM daily WHERE year(d) >= 1995"""
ORACLES["q_daily_job"] = ORACLES["q_daily_features"] + " AND symbol = 'de'"
ORACLES["q_posts_scan"] = f"""WITH {SCORED},
firsts AS (SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY ativo, data, texto ORDER BY seq) AS rn FROM posts) WHERE rn = 1)
SELECT ativo, data, CAST(length(texto) AS INT) AS n_chars, {r('sentimento')} AS sentimento
FROM firsts JOIN scored USING (seq) JOIN (SELECT seq, texto FROM posts) USING (seq)
WHERE data BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'"""
ORACLES["q_means_scan"] = f"""WITH {SCORED}
SELECT ativo, data, {r('avg(sentimento)')} AS media_sentimento FROM scored
WHERE data BETWEEN DATE '2024-01-11' AND DATE '2024-01-20' GROUP BY ativo, data"""
ORACLES["q_stream_posts"] = ORACLES["q_keep_first_posts"]
ORACLES["q_stream_malformed"] = """SELECT '{"title": ' || doc_id AS line FROM documents"""
ORACLES["q_stream_means"] = f"""WITH {SCORED},
firsts AS (SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY ativo, data, texto ORDER BY seq) AS rn FROM posts) WHERE rn = 1)
SELECT ativo, data, {r('avg(sentimento)')} AS media_sentimento, count(*) AS n FROM firsts JOIN scored USING (seq) GROUP BY ativo, data"""
ORACLES["q_means_merged"] = ORACLES["q_sentiment_daily"]

# ---- clustered ticks, tables that grow --------------------------------------------------------

ORACLES["q_features_clustered"] = ORACLES["q_features_1m"]
ORACLES["q_clustered_bars"] = ORACLES["q_minute_bars"]
ORACLES["q_eval_clustered"] = ORACLES["q_eval_join"]
ORACLES["q_daily_incremental"] = ORACLES["q_daily_features"]

# ---- the 30-minute table, metadata of both horizons, optional tables, exports, cycles ----------

ORACLES["q_upsert_h30"] = f"""WITH {PREDS}
SELECT symbol, date_trunc('minute', target)::TIMESTAMP AS target, {r('y_hat + 1')} AS y_hat, 30 AS horizon_min,
       {_THIRD} AS w_pa, 2 AS version FROM preds"""
_LAST = ", ".join(f"arg_max(mae_{m}, target) AS {m}" for m in MEMBERS)
ORACLES["q_meta_errors"] = f"""SELECT symbol, {_LAST}, 1 AS horizon_min FROM ({weights(0.01, "1e-6", True)}) GROUP BY symbol
UNION ALL SELECT symbol, {_LAST}, 30 FROM ({weights(0.02, "1e-8", False)}) GROUP BY symbol"""
_MEMBER_ERRORS = " UNION ALL ".join(
    f"SELECT symbol, {i} AS hp_id, extract(hour FROM target) % 3 AS fold, abs(price_real - y_hat_{m}) AS e FROM ev WHERE price_real IS NOT NULL"
    for i, m in enumerate(MEMBERS)
)
ORACLES["q_winner_published"] = f"""WITH {PREDS},
folds AS (SELECT symbol, hp_id, fold, avg(e) AS mae FROM ({_MEMBER_ERRORS}) GROUP BY ALL),
means AS (SELECT symbol, hp_id, avg(mae) AS mae FROM folds GROUP BY ALL),
best AS (SELECT symbol, arg_min(hp_id, row(mae, hp_id)) AS hp_id, min(mae) AS mae FROM means GROUP BY symbol),
settings AS (SELECT * FROM (VALUES (0, 0.25::DOUBLE, 1e-5::DOUBLE), (1, 0.5, 1e-4), (2, 1.0, 1e-4)) AS t(hp_id, c, alpha))
SELECT symbol, c, alpha, {r('mae')} AS mae, h AS horizon_min FROM best JOIN settings USING (hp_id), (SELECT unnest([1, 30]) AS h)"""
ORACLES["q_optional_tables"] = f"""WITH {PREDS}, {FLAGS}
SELECT symbol, count(*) AS n, 'one' AS source FROM preds GROUP BY symbol
UNION ALL SELECT ativo, count(*), 'calendar' FROM calendar WHERE ativo = 'de' GROUP BY ativo"""
ORACLES["q_export_files"] = f"""WITH e AS ({ORACLES['q_export']})
SELECT *, 'parquet' AS format FROM e UNION ALL SELECT *, 'csv' FROM e"""
ORACLES["q_minute_cycle"] = ORACLES["q_hour_bars"]
