"""Every query with SQL against that SQL on the smallest tables; grouped-map kernels against closed forms."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from barloom import plans
from barloom.functions import kernels

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "lineitem", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    a, b = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.SQL[name]).df()
    k = sorted(a)
    assert k == sorted(b)
    a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=2e-6)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_kernels():
    r = np.random.default_rng(1).normal(0, 0.01, 400)
    assert kernels.garch(np.zeros(10)) > 0
    assert 0 <= kernels.hurst(r) <= 1
    assert abs(kernels.huber_mean(np.append(r, 50.0))) < 0.01
    t = np.arange(256)
    assert kernels.dominant_period(np.sin(2 * np.pi * t / 16)) == pytest.approx(16)
    assert kernels.hull(np.arange(100.0)) == pytest.approx(99, abs=2)
    assert kernels.svd_share(np.stack([t, 2 * t, 3 * t], 1).astype(float)) == pytest.approx(1)
    x = np.random.default_rng(2).normal(size=2000)
    assert kernels.kalman_beta(x, 0.7 * x) == pytest.approx(0.7, abs=0.02)
    assert kernels.bootstrap_sharpe(r) == kernels.bootstrap_sharpe(r)


def test_upsert_and_stale(spark):
    from barloom.sources import bars

    old = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "symbol string, timestamp long, close double")
    new = spark.createDataFrame([("a", 2, 9.0), ("b", 1, 5.0)], "symbol string, timestamp long, close double")
    assert sorted(map(tuple, bars.upsert(old, new).collect())) == [("a", 1, 1.0), ("a", 2, 9.0), ("b", 1, 5.0)]
    names = spark.createDataFrame([("a",), ("c",)], "symbol string")
    assert sorted(r["symbol"] for r in bars.stale_symbols(old, names, 10, 3).collect()) == ["a", "c"]


def test_streams(spark, tmp_path):
    from barloom import streaming

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.hourly_bars(stream, "0 seconds").writeStream.format("memory").queryName("live_bars").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.table("live_bars").count() > 0
