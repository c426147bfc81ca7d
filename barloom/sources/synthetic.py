"""Made-up bars with regimes, for tests and trials."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Drift and volatility of the regimes.
FOUR = ((3e-4, 0.003), (2e-4, 0.015), (0.0, 0.004), (0.0, 0.012))
THREE = ((0.0, 0.003), (0.0, 0.015), (0.0, 0.008))
GENESIS_MS, HOUR_MS = 1_672_531_200_000, 3_600_000


def series(n: int, seed: int, regimes=FOUR, spikes: str = "edges") -> dict[str, np.ndarray]:
    """Columns of n hourly bars: equal blocks of regimes, volume spikes at the blocks' edges or at random."""
    g = np.random.default_rng(seed)
    block = np.minimum(np.arange(n) * len(regimes) // max(n, 1), len(regimes) - 1)
    drift, vol = np.array(regimes).T
    r = drift[block] + vol[block] * g.standard_normal(n)
    close = 100 * np.exp(np.cumsum(r))
    open_ = np.concatenate([[100.0], close[:-1]])[:n]
    high = np.maximum(open_, close) * (1 + np.abs(g.normal(0, 0.3, n)) * vol[block])
    low = np.minimum(open_, close) * (1 - np.minimum(np.abs(g.normal(0, 0.3, n)) * vol[block], 0.5))
    volume = g.uniform(1e6, 1e8, n)
    hot = np.append(False, block[1:] != block[:-1])[:n] if spikes == "edges" else g.random(n) < 0.1
    volume[hot] *= g.uniform(3, 10, int(hot.sum()))
    return {"timestamp": GENESIS_MS + HOUR_MS * np.arange(n), "open": open_, "high": high, "low": low, "close": close, "volume": volume, "quote_volume": volume * close, "count": g.integers(100, 10_000, n), "taker_buy_base_volume": volume * g.uniform(0.4, 0.6, n)}


def synthetic_bars(spark: SparkSession, symbols: int = 3, n: int = 2000, seed: int = 42, regimes=FOUR, spikes: str = "edges") -> DataFrame:
    """Each symbol is made in a task of its own."""
    import pandas as pd

    def make(batches):
        for b in batches:
            for k in b["id"]:
                yield pd.DataFrame({"symbol": f"SYN{k:03d}_USDT", **series(n, seed + int(k), regimes, spikes)})

    schema = "symbol string, timestamp long, open double, high double, low double, close double, volume double, quote_volume double, count long, taker_buy_base_volume double"
    return spark.range(0, symbols, 1, max(1, min(symbols, 64))).mapInPandas(make, schema)
