"""Folds, purging and bootstrap paths against plain code; carried states against the features over whole symbols."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest

from barloom.operators.carried import RUNNING, carried
from barloom.operators.features import feature
from barloom.plans import validation as V
from barloom.plans.backtest import walk_forward_splits
from barloom.sources.bars import event_bars
from barloom.sources.synthetic import synthetic_bars


def made(spark, sizes):
    g = np.random.default_rng(3)
    rows = []
    for s, n in sizes.items():
        c = 20 * np.exp(np.cumsum(g.normal(0, 0.05, n)))
        rows += [(s, i * 3_600_000, float(x), float(x * 1.01), float(x * 0.98), float(x), float(g.gamma(2, 50)), 9.0, int(g.integers(0, 40)), 1.0) for i, x in enumerate(c)]
    return spark.createDataFrame(rows, "symbol string, timestamp long, open double, high double, low double, close double, volume double, quote_volume double, count long, taker_buy_base_volume double")


def test_folds_of_each_length(spark):
    sizes = {"a": 60, "b": 1301, "c": 700, "d": 699}
    V.register(spark)
    t = spark.createDataFrame(list(sizes.items()), "symbol string, n int")
    got = spark.sql("SELECT * FROM walk_forward(TABLE({t}), 500, 200, 200, true)", t=t).collect()
    want = {(s, k, *f) for s, n in sizes.items() for k, f in enumerate(walk_forward_splits(n))}
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 5
    rolling = spark.sql("SELECT * FROM walk_forward(TABLE({t}), 50, 10, 10, false)", t=t).collect()
    assert {tuple(r) for r in rolling} == {(s, k, *f) for s, n in sizes.items() for k, f in enumerate(walk_forward_splits(n, 50, 10, 10, False))}
    paths = spark.sql("SELECT * FROM cpcv(TABLE({t}), 6, 2)", t=t).toPandas()
    for s, n in sizes.items():
        for k, chosen in enumerate(itertools.combinations(range(6), 2)):
            d = paths[(paths.symbol == s) & (paths.path == k)].sort_values("block")
            assert tuple(d[d.is_test].block) == chosen
            assert d["first"].iloc[0] == 0 and d["last"].iloc[-1] == n and (d["first"].iloc[1:].to_numpy() == d["last"].iloc[:-1].to_numpy()).all()
    runs = spark.sql("SELECT * FROM purged_train(TABLE({t}), 5, 10, 24)", t=t).toPandas()
    for s, n in sizes.items():
        for k in range(5):
            lo, hi = n * k // 5, n * (k + 1) // 5
            d = runs[(runs.symbol == s) & (runs.fold == k)]
            train = {i for a, b in zip(d["first"], d["last"], strict=True) for i in range(a, b)}
            assert train == {i for i in range(n) if i < lo - 10 or i >= hi + 24}


@pytest.mark.parametrize("width", [4, 64, 100_000])
def test_purge(spark, width):
    """Thousands of overlapping intervals, some long, against every pair."""
    g = np.random.default_rng(5)
    rows = [(s, int(i), int(g.integers(0, 30))) for s in "xyz" for i in range(900)]
    tests = [("xyz"[k % 2], int(k % 7), int(a), int(a + g.integers(0, (3, 200)[k % 50 == 0]))) for k, a in enumerate(g.integers(0, 880, 300))]
    got = V.purge(spark.createDataFrame(rows, "symbol string, i int, horizon int"), spark.createDataFrame(tests, "symbol string, fold int, test_start int, test_end int"), 6, width)
    want = {(s, f, i) for s, i, h in rows for f in {t[1] for t in tests if t[0] == s} if not any(t[0] == s and t[1] == f and i <= t[3] + 6 and i + h >= t[2] for t in tests)}
    found = [(r["symbol"], r["fold"], r["i"]) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want and len(want) > 100


def plain_paths(close, symbol, sims, block, seed):
    r = (close[1:] / close[:-1] - 1) / 100
    n = len(r)
    if n < 2 * block:
        block = 1
    out = []
    for s in range(sims):
        at = [int(hashlib.md5(f"{seed}-{symbol}-{s}-{b}".encode()).hexdigest()[:8], 16) % (n - block + 1) for b in range(-(-n // block))]
        x = np.concatenate([r[a : a + block] for a in at])[:n]
        c = np.cumprod(1 + x)
        down = x[x < 0]
        out.append((x.mean() / x.std(ddof=1) * math.sqrt(8760), np.log(c[-1]), (c / np.maximum.accumulate(c) - 1).min(), x.mean() / down.std(ddof=1) * math.sqrt(8760)))
    return np.array(out)


def test_paths(spark):
    sizes = {"long": 327, "even": 201, "short": 31}
    bars = made(spark, sizes)
    rows = bars.toPandas()
    got = {r["symbol"]: r for r in V.paths(bars, 60, 20, 7).collect()}
    for s in sizes:
        x = plain_paths(rows[rows.symbol == s].sort_values("timestamp").close.to_numpy(), s, 60, 20, 7)
        r = got[s]
        assert r["simulations"] == 60
        for k, name in enumerate(("sharpe", "log_total", "max_drawdown", "sortino")):
            v = x[:, k]
            want = (v.mean(), v.std(), np.quantile(v, 0.025), np.quantile(v, 0.975), (v > 0).mean())
            assert [r[f"{name}_{p}"] for p in ("mean", "std", "low", "high", "positive")] == pytest.approx(want, rel=1e-6, abs=2e-5), (s, name)
    again = {r["symbol"]: r for r in V.paths(bars.repartition(5), 60, 20, 7).collect()}
    assert again == got


@pytest.mark.parametrize("name", sorted(RUNNING))
@pytest.mark.parametrize("rows", [1, 7, 100, 10_000])
def test_carried_states(spark, name, rows):
    bars = event_bars(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).unionByName(made(spark, {"p": 1, "q": 83}))
    key = ["symbol", "timestamp"]
    a, b = (x.toPandas().astype({"value": float}).sort_values(key).reset_index(drop=True) for x in (carried(bars, name, rows), feature(bars, name)))
    pd.testing.assert_frame_equal(a[[*key, "value"]], b[[*key, "value"]], rtol=1e-9, atol=1e-9, check_dtype=False)


def test_one_long_symbol_in_many_tasks(spark):
    """A symbol of 300,000 bars: no task of the running pass has more than a run of it."""
    from pyspark.sql import functions as F

    bars = synthetic_bars(spark, 1, 300_000).repartition(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = carried(bars, "drawdown", 20_000)
        by_task = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in by_task) == 300_000 and max(r["count"] for r in by_task) <= 100_000
        low = out.agg(F.min("value")).first()[0]
        assert low == pytest.approx(feature(bars, "drawdown").agg(F.min("value")).first()[0], rel=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
