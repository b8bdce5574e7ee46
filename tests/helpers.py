"""Series for tests."""

import numpy as np
import pandas as pd

from pricetide.functions import scalars as S

START = pd.Timestamp("2024-01-01")


def walk(n: int, symbol: str = "a", seed: int = 7, missing: float = 0.05) -> pd.DataFrame:
    """A random walk a minute apart with jitter; some volumes are missing, some are 0."""
    rng = np.random.default_rng(seed)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, n)))
    volume = rng.integers(0, 50, n).astype(float)
    volume[rng.random(n) < missing] = np.nan
    ts = START + pd.to_timedelta(np.arange(n) * 60 + rng.integers(0, 50, n), unit="s")
    out = pd.DataFrame({"symbol": symbol, "ts": ts, "seq": np.arange(n), "price": price})
    out["open"] = price[0] if n else []
    out["volume"] = volume
    out["return_pct"] = (out["price"] / out["open"] - 1) * 100 if n else []
    return out


TICK_SCHEMA = (
    "symbol string, ts timestamp, seq long, price double, open double, volume double, return_pct double"
)


def ticks_frame(spark, pdf: pd.DataFrame):
    """Shuffled rows in four partitions, NaN as NULL."""
    mixed = pdf.sample(frac=1, random_state=0) if len(pdf) else pdf
    df = spark.createDataFrame(mixed, TICK_SCHEMA).repartition(4)
    return df.withColumns({c: S.null_if_nan(c) for c in ("price", "open", "volume", "return_pct")})
